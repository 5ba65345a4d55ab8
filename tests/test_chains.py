"""Rules in which each cut depends on the last one: folds in the JVM against plain loops, over random recordings."""

import random

import pytest

from talkloom.operators import chunking as C
from talkloom.operators import subtitles as B
from talkloom.sources import transcripts as S


def recordings(seed, n=25):
    """Segments that may overlap, stand still or leave gaps; recordings of one segment too."""
    rng, rows = random.Random(seed), []
    for v in range(n):
        t = 0
        for i in range(rng.choice([1, 2, 7, 60])):
            d = rng.choice([0, 300, 480, 2000, 9000, 41_000])
            rows.append((v, i, f"t{i}" if rng.random() < 0.8 else rng.choice([None, ""]), t, t + d))
            t += rng.choice([0, d, d + 500, d + 20_000])
    return rows


def by_video(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


def plain_large(rows, size, overlap):
    out = []
    for v, own in by_video(rows).items():
        i = n = 0
        while i < len(own):
            start, j = own[i][3], i
            while j < len(own) and own[j][4] <= start + size:
                j += 1
            j = max(j, i + 1)
            out.append((v, n, start, own[j - 1][4], own[i][1], own[j - 1][1]))
            n, i = n + 1, next((k for k in range(i + 1, len(own)) if own[k][3] >= start + size - overlap), len(own))
    return out


def plain_thin(rows, least):
    out = []
    for v, own in by_video(rows).items():
        times = sorted(r[3] for r in own)
        kept = times[:1]
        for t in times[1:]:
            if t - kept[-1] >= least:
                kept.append(t)
        if kept[-1] != times[-1]:
            if len(kept) > 1 and times[-1] - kept[-1] < least:
                kept.pop()
            kept.append(times[-1])
        out += [(v, n, t) for n, t in enumerate(kept)]
    return out


def plain_span(rows, span):
    out = []
    for v, own in by_video(rows).items():
        n, start = 0, None
        for r in own:
            start = r[3] if start is None else start
            out.append((v, r[1], n))
            if r[4] - start >= span:
                n, start = n + 1, None
    return out


def plain_short(rows, short):
    out = []
    for v, own in by_video(rows).items():
        own = [list(r) for r in own]
        for i in range(len(own) - 1, 0, -1):
            if 0 < own[i][4] - own[i][3] < short:
                own[i - 1][4] = max(own[i - 1][4], own[i][4])
                own[i - 1][2] = " ".join(x for x in (own[i - 1][2], own[i][2]) if x)
                del own[i]
        out += [tuple(r) for r in own]
    return out


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("InPandas", "MapInArrow", "ArrowEvalPython", "BatchEvalPython"))


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_are_the_loops(spark, seed):
    rows = recordings(seed)
    df = spark.createDataFrame(rows, "video_id long, seg_no long, text string, start_ms long, end_ms long").repartition(3)
    turns = df.withColumnRenamed("seg_no", "turn_no")
    bounds = df.withColumnRenamed("start_ms", "at_ms")
    cases = [
        (C.large_chunks(df, 60_000, 15_000), plain_large(rows, 60_000, 15_000), ["video_id", "chunk_no", "start_ms", "end_ms", "first_seg", "last_seg"]),
        (C.thin_boundaries(bounds, 12_000), plain_thin(rows, 12_000), ["video_id", "n", "at_ms"]),
        (C.split_by_span(df, 45_000), plain_span(rows, 45_000), ["video_id", "seg_no", "chunk_no"]),
        (B.merge_short_turns(turns, 500), plain_short(rows, 500), ["video_id", "turn_no", "text", "start_ms", "end_ms"]),
    ]
    for made, want, columns in cases:
        assert no_python(made)
        assert sorted(map(repr, (tuple(r) for r in made.select(*columns).collect()))) == sorted(map(repr, want))


def test_saved_results_read_only_the_folders_they_need(spark, tmp_path):
    """Ids from a table that nothing has filtered: the scan names their folders, and reads no file of another one."""
    path = str(tmp_path / "saved")
    S.save_analysis(spark.range(500).selectExpr("id AS video_id", "id * 2 AS x"), path)
    ids = spark.createDataFrame([(3,), (77,), (77,), (1000,)], "video_id long")
    found = S.load_analysis(spark, path, ids)
    assert sorted((r.video_id, r.x) for r in found.collect()) == [(3, 6), (77, 154)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = S.load_analysis(spark, path, ids)
        executed = again._jdf.queryExecution().executedPlan()
        executed.execute().count()
        leaves = executed.collectLeaves()
        files = [leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if "FileScan" in leaves.apply(i).toString() or "Scan parquet" in leaves.apply(i).nodeName()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert files and max(files) <= 3
