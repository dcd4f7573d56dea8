"""Line operators against plain Python."""
import random

from pyspark.sql import functions as F

from drawmark.operators import lines


def arrays(spark, data, *cols):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(data)], "i int, a array<int>")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def samples(n=200, top=600):
    random.seed(5)
    return [sorted(random.sample(range(top), random.randint(0, 14))) for _ in range(n)]


def spaced(a, gap):
    out = []
    for x in a:
        if not out or x - out[-1] > gap:
            out.append(x)
    return out


def test_keep_spaced(spark):
    data = samples()
    assert [g[0] for g in arrays(spark, data, lines.keep_spaced(F.col("a"), 30))] == [spaced(a, 30) for a in data]


def test_grid_rows(spark):
    def plain(a, h, tol=3):
        if not a:
            return []
        rows = [a[0]]
        while True:
            near = [(abs(y - rows[-1] - h), y) for y in a if y > rows[-1] and abs(y - rows[-1] - h) <= tol]
            if not near:
                return rows
            rows.append(min(near)[1])
    data = [sorted(set(a + [10, 61, 112, 160])) for a in samples()]
    assert [g[0] for g in arrays(spark, data, lines.grid_rows(F.col("a"), F.lit(50)))] == [plain(a, 50) for a in data]


def linked(segs, c, gap):
    seed = next((s for s in segs if s[0] <= c + 10 and s[1] >= c - 10), None)
    if seed is None:
        return None
    lo, hi = seed
    changed = True
    while changed:
        changed = False
        for a, b in segs:
            if a > hi and a - hi <= gap:
                hi, changed = b, True
            if b < lo and lo - b <= gap:
                lo, changed = a, True
    return lo, hi


def test_linked_extent(spark):
    random.seed(8)
    data = []
    for _ in range(150):
        starts = [random.randint(0, 900) for _ in range(random.randint(0, 12))]
        data.append(sorted({(s, s + random.randint(5, 90)) for s in starts}))
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, a array<struct<lo:int,hi:int>>")
    got = df.select("i", lines.linked_extent(F.col("a"), F.lit(450), 80).alias("e")).orderBy("i").collect()
    assert [tuple(r["e"]) if r["e"] else None for r in got] == [linked(d, 450, 80) for d in data]


def test_extended_rows(spark):
    def plain(rows, cand, bottom, page):
        if len(rows) < 2:
            return rows
        step = max(int((rows[-1] - rows[0]) / (len(rows) - 1) * 3), 100)
        out, top, limit = list(rows), bottom, min(page, bottom + step * 3)
        while top < limit:
            bot = min(page, top + step)
            found = [y for y in cand if top <= y < bot]
            if not found:
                break
            out += found
            top = found[-1] + 1
        return out
    data = samples(300, 1500)
    rows = F.filter("a", lambda y: y < 200)
    got = arrays(spark, data, lines.extended_rows(rows, F.col("a"), F.lit(200), F.lit(1200)))
    assert [g[0] for g in got] == [plain([y for y in a if y < 200], a, 200, 1200) for a in data]


def test_profile_lines(spark):
    from drawmark.operators.profiles import with_profile_lines
    random.seed(2)
    pages = [(i, sorted(random.sample(range(300), 4))) for i in range(40)]
    profile = [(i, p, random.randint(1, 9)) for i in range(40) for p in random.sample(range(300), 60)]
    want = set()
    for i, ps in pages:
        mine = {p: v for j, p, v in profile if j == i}
        limit, known = max(sum(mine.values()) / 300 * 3, 0.15), list(ps)
        for x in range(1, 299):
            if mine.get(x, 0) > limit and not any(abs(x - e) <= 10 for e in known):
                known.append(x)
        want |= {(i, x) for x in known}
    got = with_profile_lines(spark.createDataFrame(pages, "page_id int, ps array<int>"), spark.createDataFrame(profile, "page_id int, pos int, value int"), side=300)
    assert {tuple(r) for r in got.collect()} == want
