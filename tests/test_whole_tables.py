"""Queries that read whole tables, against brute force over tables larger than any list or draw."""

from rallyspark.plans import catalogue

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def merged(ids: list[int]) -> list[tuple]:
    """Ids of one list by the rules of the merge; names of this query are alike only if they are equal."""
    points, used, out = lambda c: c % 50 + (c % 4 == 0), set(), []
    for c in ids:
        found = [x for x in ids if x not in used and (x % 400, x % 3) == (c % 400, c % 3)]
        found = [x for x in found if points(x) == c % 50] or found
        near = sorted((abs(x + x % 5 - c), x + x % 5, x) for x in found)
        if not near or len(near) > 1 and near[0][0] == near[1][0]:
            out.append((c, None, None, "ambiguous" if near else "unmatched"))
        else:
            used.add(near[0][2])
            out.append((c, f"id{near[0][2]}", near[0][1], "matched" if len(near) == 1 else "rank_fallback"))
    return out


def test_ranking_lists_of_all_customers(spark, tmp_path):
    ids = range(1, 12001)
    spark.createDataFrame([(c, SEGMENTS[c * 7919 % 11 % 5]) for c in ids], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    lists: dict[str, list[int]] = {}
    for c in ids:
        lists.setdefault(f"{SEGMENTS[c * 7919 % 11 % 5]}/{c // 5000}", []).append(c)
    want = {(k, *row) for k, own in lists.items() for row in merged(own)}
    got = catalogue.QUERIES["ranking_id_merge"](spark, str(tmp_path)).collect()
    assert len(got) == len(ids) and {(r.category, r.seq, r.player_id, r.results_rank, r.status) for r in got} == want
    assert {r[4] for r in want} >= {"matched", "rank_fallback"} and max(map(len, lists.values())) < 2500


def test_brackets_of_all_orders(spark, tmp_path):
    ids = range(2048)
    spark.createDataFrame([(k, k * 31 % 97, "FOP"[k % 11 % 3]) for k in ids], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    placed = catalogue.QUERIES["bracket_positions"](spark, str(tmp_path)).collect()
    assert sorted((r.match_id, r.event_id) for r in placed) == [(k, k // 512) for k in ids]
    for name, events in (("champions_all", 2048 // 64), ("team_champions", 4)):
        assert sorted(r.event_id for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()) == list(range(events)), name
