"""Functions of source files as a SQL table function.

    table.register(spark)
    spark.sql("SELECT d.doc_id, f.name FROM documents d, LATERAL functions(d.text, d.lang) f")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from auditspark.functions import code
from auditspark.shipping import ship

NAME = "functions"


@udtf(returnType="name string, kind string, signature string, body string, first_line int, last_line int")
class Functions:
    """Rows of ``code.extract_functions`` for one text; a null text has none, a null
    language is read as one with braces."""

    def eval(self, text: str, lang: str) -> Iterator[tuple]:
        yield from code.functions_of(text or "", lang or "")


def register(spark: SparkSession, name: str = NAME) -> None:
    """Make the table function known to SQL."""
    ship(spark)
    spark.udtf.register(name, Functions)
