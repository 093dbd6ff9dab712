from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_of(df: DataFrame) -> str:
    """The physical plan as text."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()
