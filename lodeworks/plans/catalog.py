"""Imports every module that registers queries."""

from lodeworks.plans import analytics, planning, retrieval, text, trust, loops, state, answers, records  # noqa: F401
