"""No query broadcasts a table with a row a cell because its file is small."""

import pytest

from rillwork.option_queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Between the files of the written tables (32,000 cells in some 20 KB) and that of the elevations (193 KB), as Spark's 10 MB are on large rasters.
CONF = {"spark.sql.autoBroadcastJoinThreshold": "100000", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
#: Tables with a row a tile, a part or a result may be broadcast.
MOST = 500


@pytest.fixture
def held(spark):
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def broadcast_rows(spark, run):
    """The rows of each broadcast made meanwhile."""
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {x.executionId() for x in _items(store.executionsList())}
    before = ids()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    rows = []
    for i in ids() - before:
        values = store.executionMetrics(i)
        for node in _items(store.planGraph(i).allNodes()):
            if node.name() == "BroadcastExchange":
                rows += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in _items(node.metrics()) if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return rows


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


@pytest.mark.parametrize("name", ["basin_hydrology", "hand", "hand_euclidean", "main_stem", "link_basins", "pfafstetter", "prune_short", "stream_links", "resolve_flats", "stream_order_hack", "stream_order_horton", "stream_order_shreve", "stream_order_strahler", "upscale_cotat", "upscale_dmm", "upscale_eam"])
def test_rasters_are_not_broadcast(held, name):
    assert max(broadcast_rows(held, lambda: QUERIES[name](held, SF).count()), default=0) <= MOST
