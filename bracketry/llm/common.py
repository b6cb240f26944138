"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.session import checkpointed, discard, ship, table, work_dir

__all__ = ["broadcast_bytes", "checkpointed", "discard", "ship", "table", "text_of", "training_row", "work_dir"]

#: ASCII white space of the word contracts.
SPACE = r"\x20\x09-\x0D"


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared store."""
    _MADE.append(f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


@contextmanager
def passing(spark: SparkSession):
    """Scratch folders made within are removed at its end."""
    before = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[before:]:
            discard(spark, path)
        del _MADE[before:]


def packed_row(docs: DataFrame, *without: str):
    """A struct of all columns of docs but those named, so that columns beside it can have any name."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without], F.lit(0).alias("__end"))


def unpacked_row(docs: DataFrame, struct: str, *without: str) -> list:
    """The columns of docs out of the struct that packed_row made."""
    return [F.col(struct).getField(c).alias(c) for c in docs.columns if c not in without]


def text_of(column: str = "text"):
    """The text with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder(column: str, mod: int):
    """crc32 of the id's decimal text, mod `mod`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


def training_row(column: str, mod: int):
    return remainder(column, mod) != 2


def broadcast_bytes(spark: SparkSession, payload: bytes, limit: int):
    """Broadcast a payload whose size is checked against its stated bound."""
    if len(payload) > limit:
        raise ValueError(f"payload of {len(payload)} bytes exceeds its bound of {limit}")
    return spark.sparkContext.broadcast(payload)


_RESIDENT: dict = {}


def resident(key, build):
    """What a Python worker keeps between batches: one operator's state at a time, built where it isn't there. Workers outlive stages, so the state of an earlier stage goes."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = build()
    return _RESIDENT[key]
