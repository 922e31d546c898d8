"""Operations of a training-data pipeline over a ``documents`` table.

Nothing outside this subpackage imports it.  Every operator takes and
returns DataFrames, reads its inputs only through Spark, and keeps shared
state only in the folder that ``spark.checkpoint.dir`` names.
"""
