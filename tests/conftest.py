"""One session for all tests, and the small graphs that they share."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from strandloom.session import local_session  # noqa: E402
from strandloom.tables import Graphs  # noqa: E402

NODES = "node_id string, graph_id bigint, block_id string, path_id string, strand string, pos_start bigint, pos_end bigint, loaded_at timestamp_ntz"
PATHS = "path_id string, graph_id bigint, nodes array<string>, tot_len bigint, circular boolean, path_name string, descr string, loaded_at timestamp_ntz"
BLOCKS = "graph_id bigint, block_id string, consensus string, alignments map<string, struct<subs:array<struct<pos:int,alt:string>>,dels:array<struct<pos:int,len:int>>,inss:array<struct<pos:int,seq:string>>>>"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 2, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_graph(spark):
    """Graphs of walks such as {'s1': '100+ 500- 200+'} and block lengths or sequences; ids of nodes run on."""

    def make(walks, blocks, circular=True, edits=None, graph_id=0):
        consensus = {b: "A" * c if isinstance(c, int) else c for b, c in blocks.items()}
        nodes, paths, held, n = [], [], {b: {} for b in blocks}, 0
        for p, (name, walk) in enumerate(walks.items(), 1):
            at, mine = 0, []
            for step in walk.split():
                n += 1
                b, s = step[:-1], step[-1]
                edit = (edits or {}).get(n, {"subs": [], "dels": [], "inss": []})
                size = len(consensus[b]) - sum(d["len"] for d in edit["dels"]) + sum(len(i["seq"]) for i in edit["inss"])
                nodes.append([str(n), graph_id, b, str(p), s, at, at + size, None])
                held[b][str(n)] = edit
                mine.append(str(n))
                at += size
            if circular and mine:
                nodes[-1][6] = 0  # the last place ends where the first begins
            paths.append((str(p), graph_id, mine, at, circular, name, None, None))
        rows = [(graph_id, b, c, held[b]) for b, c in consensus.items()]
        return Graphs(
            spark.createDataFrame([tuple(x) for x in nodes], NODES), spark.createDataFrame(paths, PATHS), spark.createDataFrame(rows, BLOCKS)
        )

    return make


@pytest.fixture(scope="session")
def empty_graph(spark):
    return Graphs(spark.createDataFrame([], NODES), spark.createDataFrame([], PATHS), spark.createDataFrame([], BLOCKS))


def rows(df, *cols):
    """All rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
