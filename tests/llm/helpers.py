"""Small tables with the cases every operator must bear."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(c, T.LongType() if c in ("doc_id", "n_chars") else T.StringType())
                     for c in ("doc_id", "text", "lang", "source", "n_chars")])
#: Columns whose names operators use themselves.
EXTRA = ("size", "key", "fp", "root", "target", "slot", "shard", "language", "contamination", "n", "start", "evidence",
         "host", "gone", "mix_size", "did")

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


def docs(spark, rows, extra=False):
    """Rows are (doc_id, text[, lang[, source]]); optionally with clashing columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, 0) for r in rows]
    schema = DOCS
    if extra:
        full = [r + ("x",) * len(EXTRA) for r in full]
        schema = T.StructType(DOCS.fields + [T.StructField(c, T.StringType()) for c in EXTRA])
    return spark.createDataFrame(full, schema)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
