"""Table functions for SQL: the lines and the tokens of a source, one row each.

register(spark) names them `classify_lines(content)` and `source_tokens(content)`; they are used with LATERAL. A null
content has no rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.cfront import lexer


def _bytes(content) -> bytes:
    return b"" if content is None else content.encode() if isinstance(content, str) else bytes(content)


@udtf(returnType="line int, kind string")
class ClassifyLines:
    def eval(self, content):
        for n, kind in enumerate(lexer.line_kinds(_bytes(content)), 1):
            yield n, kind


@udtf(returnType="place int, kind string, spelling string, begin_at bigint, end_at bigint")
class SourceTokens:
    def eval(self, content):
        for n, t in enumerate(lexer.lex(_bytes(content))):
            yield n, t.kind, t.text.encode("latin-1").decode("utf-8", "replace"), t.begin, t.end


def register(spark: SparkSession) -> None:
    spark.udtf.register("classify_lines", ClassifyLines)
    spark.udtf.register("source_tokens", SourceTokens)
