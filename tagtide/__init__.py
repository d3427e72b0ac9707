"""tagtide: labelled-token corpora (IOB2) as Spark DataFrames.

A language is a column, a corpus is a partitioned table, and every order the
file format implies is an explicit key (file, sentence ordinal, position).
"""

from tagtide.session import checkpoint_dir, get_session, read_table

__all__ = ["checkpoint_dir", "get_session", "read_table"]
