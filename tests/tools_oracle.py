"""Test-side import of the comparison helpers used by tools/oracle_check.py."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from oracle_check import SPARK_TO_DUCK, TABLES, close, rows_of  # noqa: E402,F401
