"""Small helpers of the text operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.session import settle


def col(name: str) -> Column:
    """Column by its plain name, also when the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under internal names; columns that clash with them are left behind."""
    return df.select(*(col(name).alias(alias) for alias, name in names.items()))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def tokenizer_path(name: str) -> str:
    """File of a public tokenizer; ``WAYLINE_TOKENIZERS`` names the folder, else the installed package does."""
    folder = os.environ.get("WAYLINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def number_rows(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """``df`` written in ``order`` over its partitions, with a number that ascends along it and is no other row's."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(placed.withColumn(name, F.monotonically_increasing_id()), label)


def map_columns(
    df: DataFrame, fn: Callable[[list], Iterator[tuple[list, ...]] | tuple[list, ...]], schema: str
) -> DataFrame:
    """``fn`` gets the columns of a batch as Arrow arrays and gives the output columns in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch.columns)
                for columns in [out] if isinstance(out, tuple) else out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=fields
                    )
                # a worker serves many stages: what Arrow keeps in reserve adds up
                del out
                pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


#: DuckDB has no crc32: a table of one value per byte, as the CTE ``crc_table``, and an expression over it.
CRC32_SQL = (
    "crc_table AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]), "
    "lambda c, b : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS v FROM range(256) r(i))"
)


def crc32_of(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes, in a SELECT that has ``crc_table`` in its FROM."""
    codes = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i : ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    steps = f"list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b : xor(crc_table.v[(xor(c, b) & 255) + 1], c >> 8))"
    return f"xor({steps}, 4294967295)"
