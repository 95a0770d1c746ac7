import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm.exchange import SCHEMA, bundled, delivered, forgotten, received, sent, table, unbundled
from tidemark.llm.shared import exists, shared_dir


@given(st.lists(st.binary(max_size=20), min_size=1, max_size=5))
def test_bundles(parts):
    assert [bytes(x) for x in unbundled(memoryview(bundled(*parts)), len(parts))] == parts


def test_no_message_gives_no_row():
    assert len(table(sent(3, []))) == 0 == len(received(table([])))


@pytest.mark.parametrize(("nodes", "fan"), [(1, 4), (4, 4), (13, 4), (26, 4), (20, 3)])
def test_all_messages_arrive(spark, nodes, fan):
    rng = random.Random(nodes)
    messages = [(s, d, f"{s} to {d}".encode() * rng.randint(0, 2)) for s in range(nodes) for d in range(nodes) if rng.random() < 0.8]
    by = {s: [m for m in messages if m[0] == s] for s in range(nodes)}

    def send(t):
        at = t.column("node")[0].as_py()
        return table(sent(at, by[at], fan))

    folder = f"{shared_dir(spark)}/x"
    rows = delivered(spark.range(nodes).withColumnRenamed("id", "node").groupBy("node").applyInArrow(send, SCHEMA), nodes, folder, fan)
    got = [(r.node, m) for r in rows.collect() for m in received(table([r.asDict()]))]
    assert all(node == d for node, (_, d, _) in got)
    assert sorted((s, d, bytes(c)) for _, (s, d, c) in got) == sorted(messages)
    forgotten(spark, folder)
    assert not exists(spark, f"{folder}-0")


def rows_of_a_step(nodes, fan):
    """Rows that the first step of an exchange between all nodes makes."""
    return sum(len([*sent(s, ((s, d, b"") for d in range(nodes)), fan)]) for s in range(nodes))


def test_rows_grow_with_the_nodes():
    assert rows_of_a_step(200, 8) == 200 * 8 and rows_of_a_step(400, 8) == 400 * 8
