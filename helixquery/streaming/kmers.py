"""k-mer counts over a folder where records keep arriving. An extension: nothing to be reproduced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixquery.operators.kmers import windows


def running_counts(records: DataFrame, id_col: str, seq: str, k: int) -> DataFrame:
    """kmer, occurrences so far; records is a stream, the result is for the update or complete output mode."""
    return windows(records, id_col, seq, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("occurrences"))
