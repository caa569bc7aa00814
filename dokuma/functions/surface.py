"""The library from SQL: table functions and views that ``register`` makes known to a session.

Each table function takes a table with the columns doc_id and text, and options by name:

    SELECT * FROM law_references(TABLE(documents))
    SELECT * FROM sentence_chunks(TABLE(SELECT doc_id, body AS text FROM pages), most => 256, overlap => 32)

and gives doc_id, of the type it has there, with the columns of its operator: ``law_references`` (width), ``citations``,
``sentence_chunks`` (most, overlap), ``token_windows`` (most, overlap), ``sections`` (most). A null text has no rows. Rows are
worked on where they are; nothing is shuffled. ``resolve_views`` makes the views ``resolved`` and ``unresolved``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from dokuma.operators import citations, extract, resolve


def _windows(text: str, most: int = 512, overlap: int = 64) -> Iterator[tuple]:
    """As ``extract.token_windows``, for one text."""
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    for i, at in enumerate(range(0, max(len(words) - overlap, 1), most - overlap) if words else ()):
        piece = words[at : at + most]
        yield i, " ".join(piece), len(piece)


def _numbered(rows: Callable) -> Callable:
    return lambda text, **options: ((i, *x) for i, x in enumerate(rows(text, **options)))


#: name -> (rows of a text, their columns, options that are known)
FUNCTIONS = {
    "law_references": (extract.law_references, extract.LAW, {"width"}),
    "citations": (_numbered(citations.citations), citations.CITATION, set()),
    "sentence_chunks": (_numbered(extract.chunks_of), extract.CHUNK, {"most", "overlap"}),
    "token_windows": (_windows, extract.CHUNK, {"most", "overlap"}),
    "sections": (_numbered(extract.sections_of), extract.SECTION, {"most"}),
}


def _handler(name: str, rows: Callable, columns: str, known: set[str]) -> type:
    kinds = {"string": StringType(), "int": IntegerType()}
    own = [StructField(n, kinds[kind]) for n, kind in map(str.split, columns.split(", ")[1:])]

    class Handler:
        @staticmethod
        def analyze(table: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable or not {"doc_id", "text"} <= set(table.dataType.names):
                raise ValueError(f"{name} takes a table with doc_id and text")
            for option, given in options.items():
                if option not in known:
                    raise ValueError(f"{name} has no option {option}; it has {', '.join(sorted(known)) or 'none'}")
                if not given.isConstantExpression or not isinstance(given.value, int) or given.value < 0:
                    raise ValueError(f"{option} of {name} is a whole number, the same for all rows")
            return AnalyzeResult(StructType([table.dataType["doc_id"], *own]))

        def eval(self, row: Row, **options: int) -> Iterator[tuple]:
            if row["text"] is not None:
                for x in rows(row["text"], **options):
                    yield (row["doc_id"], *x)

    return Handler


def register(spark: SparkSession) -> list[str]:
    """Make all table functions known to the session; returns their names."""
    for name, parts in FUNCTIONS.items():
        spark.udtf.register(name, udtf(_handler(name, *parts)))
    return list(FUNCTIONS)


def resolve_views(spark: SparkSession, citations: str, documents: str, vocabulary: str | None = None) -> None:
    """The views ``resolved`` and ``unresolved`` over tables or views by name, as ``resolve.resolve`` takes them."""
    good, bad = resolve.resolve(spark.table(citations), spark.table(documents), spark.table(vocabulary) if vocabulary else None)
    good.createOrReplaceTempView("resolved")
    bad.createOrReplaceTempView("unresolved")
