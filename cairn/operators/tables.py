"""Slicing, definitions and tokens as table functions of SQL.

After ``register(spark)``::

    SELECT * FROM slice_code(TABLE(files))
    SELECT * FROM slice_code(TABLE(files) PARTITION BY doc_id, least => 40, most => 240, fill_gaps => false)
    SELECT * FROM definitions_in(TABLE(files))
    SELECT d.doc_id, t.* FROM docs d, LATERAL token_spans(d.text) t

Files have doc_id, text and programming_language; each row is read on its own, so a partition may hold one file or many.
Without PARTITION BY the files are read where they lie; with it their texts are shuffled and sorted first.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .derive import CHUNK, MAX_TOKENS, MIN_TOKENS, TOKEN, token_starts
from .slicing import DEFINITION, chunk_rows, code_spans, definition_rows


class SliceCode:
    def eval(self, file: Row, least: int = MIN_TOKENS, most: int = MAX_TOKENS, fill_gaps: bool = True) -> Iterator[tuple]:
        text = file["text"] or ""
        yield from chunk_rows(file["doc_id"], text, code_spans(text, file["programming_language"], token_starts, least, most, fill_gaps))


class DefinitionsIn:
    def eval(self, file: Row) -> Iterator[tuple]:
        yield from definition_rows(file["doc_id"], file["text"], file["programming_language"])


class TokenSpans:
    def eval(self, text: str) -> Iterator[tuple]:
        for k, m in enumerate(TOKEN.finditer(text or "")):
            yield k, m.start(), m.end(), m[0]


def register(spark: SparkSession) -> None:
    spark.udtf.register("slice_code", udtf(SliceCode, returnType=CHUNK))
    spark.udtf.register("definitions_in", udtf(DefinitionsIn, returnType=DEFINITION))
    spark.udtf.register("token_spans", udtf(TokenSpans, returnType="k int, start int, end int, token string"))
