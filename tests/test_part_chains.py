"""Chains of whole parts in arrays, against the operators over the whole graph."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandframe.operators import chains, part_chains
from strandframe.operators import graph as G
from strandframe.plans import catalogue
from strandframe.sources import writers


def parts(count, seed):
    """Random small graphs, half of them bubble chains with a few links changed; each part has names of its own, in no order."""
    rng, out = random.Random(seed), []
    for part in range(count):
        names = [part * 100 - 500 + x for x in rng.sample(range(100), 40)]
        if part % 2:
            links, at = [], 0
            for _ in range(rng.randint(1, 7)):
                if rng.random() < 0.5:
                    links += [(at, at + 1), (at, at + 2), (at + 1, at + 3), (at + 2, at + 3)]
                    at += 3
                else:
                    links.append((at, at + 1))
                    at += 1
            if rng.random() < 0.4:
                links.append((rng.randint(0, at), rng.randint(0, at)))
            if rng.random() < 0.2:
                links.pop(rng.randrange(len(links)))
            back = [rng.random() < 0.3 for _ in range(at + 1)]
            out += [(part, names[a], back[a], names[b], back[b]) for a, b in links]
        else:
            n = rng.randint(1, 9)
            out += [(part, names[rng.randrange(n)], rng.random() < 0.5, names[rng.randrange(n)], rng.random() < 0.5) for _ in range(rng.randint(1, 12))]
    return out


@pytest.mark.parametrize(("long", "block"), [(1000, 250_000), (3, 50)])
def test_places_as_over_the_whole_graph(spark, monkeypatch, long, block):
    monkeypatch.setattr(part_chains, "LONG", long)
    monkeypatch.setattr(part_chains, "LONG", long)
    rows = parts(600, long)
    links = spark.createDataFrame(rows, "part long, node_a long, rev_a boolean, node_b long, rev_b boolean")
    halves, phase = G.half_edges(links), lambda c: (F.pmod(F.hash(c), F.lit(7)) % 3 - 1).cast("int")
    nodes = halves.select("node").distinct()
    whole = chains.chains(halves, nodes)
    want = sorted(map(tuple, writers.chain_rows(nodes, chains.chain_paths(whole, nodes.withColumn("partition", phase("node")))).collect()))

    def run(batches):
        part_chains.BLOCK, part_chains.LONG = block, long  # workers do not see what the test has set
        yield from part_chains.places_of(batches)

    named = links.repartition(3, "part").sortWithinPartitions("part").withColumn("partition_a", phase("node_a")).withColumn("partition_b", phase("node_b"))
    got = writers.chain_colours(named.select(*part_chains.COLUMNS).mapInArrow(run, part_chains.PLACES))
    assert sorted(map(tuple, got.collect())) == want
    assert len({colour for _, colour in want}) == 5

    np = part_chains.np
    part, a, ra, b, rb = (np.array(x) for x in zip(*rows, strict=True))
    names, p, q, _ = part_chains.graph_of(a, ra, b, rb)
    chain, layer, node, back = part_chains.layers(len(names), p, q)
    assert sorted(zip(names[chain].tolist(), layer.tolist(), names[node].tolist(), back.tolist(), strict=True)) == sorted(map(tuple, whole.collect()))


def test_a_part_in_two_places_is_an_error():
    row = lambda part: pa.RecordBatch.from_pydict({"part": [part], "node_a": [1], "rev_a": [False], "partition_a": [1], "node_b": [2], "rev_b": [False], "partition_b": [1]})
    with pytest.raises(ValueError, match="order"):
        list(part_chains.places_of(iter([row(2), row(1)])))


def test_paths_of_over_a_hundred_steps_are_not_dealt_out(spark, tmp_path):
    db = duckdb.connect()
    for name, sql in {"lineitem": "SELECT * REPLACE (row_number() OVER () // 101 * 10 AS l_orderkey) FROM '{}' LIMIT 250", "part": "SELECT * FROM '{}'"}.items():
        db.execute(f"COPY ({sql.format(f'/root/testdata/sf0.001/{name}.parquet')}) TO '{tmp_path}/{name}.parquet'")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = sorted(db.execute(catalogue.ORACLES["chain_csv"]).fetchall())
    assert catalogue._path_shares(spark, str(tmp_path)) == [] and len(want) > 250
    assert sorted(map(tuple, catalogue.QUERIES["chain_csv"](spark, str(tmp_path)).select("node", "color").collect())) == want
