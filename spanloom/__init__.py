"""Span annotation analytics as Spark DataFrame jobs.

Two table layouts are used throughout:

* sentence rows  -- one row per sentence, tokens / tags / span sets as arrays.
  A sentence always arrives as one row, so work on these rows is narrow
  (no shuffle) and bounded by the row.
* span rows      -- one row per (sentence, span); used wherever rows of
  different tables meet.  Joins and groupings carry the sentence key plus the
  span, so one long document or sentence spreads over many tasks.

Span ends are exclusive at the edges (sources, JSON) and inclusive inside.
"""

KEYS = ("doc_id", "sent_ix")
