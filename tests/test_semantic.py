"""Candidate edges against all pairs of a small table."""

import math

from lodestone.operators import semantic


def test_mutual_pairs_planes_and_contradictions(spark, tmp_path):
    at = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    rows = [
        (1, "claim", "world", 1, at(0)), (2, "claim", "world", 0, at(5)), (3, "claim", "dream", 1, at(6)), (4, "claim", None, None, at(8)), (5, "claim", "world", 1, at(90)),
        (6, "event", "world", 1, at(0)), (7, "event", "world", 1, at(3)), (8, None, "world", 1, at(0)), (9, "event", "world", 1, None), (None, "event", "world", 1, at(1)),
    ]
    nodes = spark.createDataFrame(rows, "id long, family string, plane string, polarity int, v array<double>")
    got = {(r.a, r.b): (r.family, r.kind) for r in semantic.candidate_edges(nodes, str(tmp_path / "s"), 2, 0.9, 100).collect()}
    # the two nearest of 1 are 2, 3; of 2: 3, 4; of 3: 2, 4; of 4: 3, 2; planes part 2 and 3
    assert got == {(2, 4): ("claim", "supports"), (3, 4): ("claim", "supports"), (6, 7): ("event", "supports")}
    wide = {(r.a, r.b): r.kind for r in semantic.candidate_edges(nodes, str(tmp_path / "w"), 4, 0.9, 100).collect()}
    assert wide[1, 2] == "contradicts" and wide[1, 4] == "supports" and (1, 3) not in wide and (4, 5) not in wide
    assert semantic.candidate_edges(nodes.limit(0), str(tmp_path / "e")).count() == 0
