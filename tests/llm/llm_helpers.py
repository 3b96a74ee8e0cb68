"""Small tables for the tests of this folder."""


def docs_of(spark, rows):
    """``documents`` from (doc_id, text) or (doc_id, text, lang, source) rows."""
    full = [(*r, "en", "src0")[:4] if len(r) < 4 else r for r in rows]
    return spark.createDataFrame(
        [(*r, None if r[1] is None else len(r[1])) for r in full],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
