"""All-to-all messages between numbered nodes, in a number of rows that grows with the nodes and not with their square.

Each node sends a message to each other one. As a row a message, n nodes would make n * n rows. Here a node's number is
written in digits to the base `fan`; in the step for a digit, messages go to the node that has this digit of their
destination and the other digits of where they are, all that go there in one row. A step moves at most n * fan rows,
and after as many steps as there are digits, all messages are where they belong. Up to `fan` nodes it is one step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.shared import removed, written

FAN = 128
SCHEMA = "node long, heads binary, body binary"
ARROW = pa.schema([("node", pa.int64()), ("heads", pa.binary()), ("body", pa.binary())])


def bundled(*parts: bytes) -> bytes:
    """Several strings of bytes as one."""
    return b"".join([np.array([len(p) for p in parts], "<i8").tobytes(), *parts])


def unbundled(raw: memoryview, n: int) -> list[memoryview]:
    ends = 8 * n + np.cumsum(np.frombuffer(raw[: 8 * n], "<i8"))
    return [raw[a:b] for a, b in zip([8 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def sent(at: int, messages: Iterable[tuple[int, int, bytes]], fan: int = FAN, step: int = 0) -> Iterator[dict]:
    """The rows of ARROW in which a node hands on its messages (source, destination, content)."""
    place = fan**step
    out: dict[int, list] = {}
    for m in messages:
        out.setdefault(m[1] // place % fan, []).append(m)
    for digit, own in out.items():
        heads = np.array([(s, d, len(c)) for s, d, c in own], "<i8")
        yield {"node": at + (digit - at // place % fan) * place, "heads": heads.tobytes(), "body": b"".join([c for *_, c in own])}


def received(rows: pa.Table) -> list[tuple[int, int, memoryview]]:
    """The messages in rows, by source."""
    out = []
    for heads, body in zip(rows.column("heads"), rows.column("body"), strict=True):
        at, view = 0, memoryview(body.as_buffer())
        for s, d, n in np.frombuffer(heads.as_buffer(), "<i8").reshape(-1, 3).tolist():
            out.append((s, d, view[at : at + n]))
            at += n
    return sorted(out, key=lambda m: m[0])


def table(rows: Iterable[dict], schema: pa.Schema = ARROW) -> pa.Table:
    return pa.Table.from_pylist([*rows], schema)


def delivered(rows: DataFrame, nodes: int, folder: str, fan: int = FAN, how: dict[str, str] | None = None) -> DataFrame:
    """Written rows of ARROW that are where they belong, from those that nodes sent in step 0."""
    rows, step = written(rows, f"{folder}-0", how), 1

    def relay(step: int):
        return lambda t: table(sent(t.column("node")[0].as_py(), received(t), fan, step))

    while fan**step < nodes:
        rows = written(rows.groupBy("node").applyInArrow(relay(step), SCHEMA), f"{folder}-{step}", how)
        removed(rows.sparkSession, f"{folder}-{step - 1}")
        step += 1
    return rows


def forgotten(spark: SparkSession, folder: str) -> None:
    """Deletes what delivered() wrote to folder."""
    for step in range(10):
        removed(spark, f"{folder}-{step}")
