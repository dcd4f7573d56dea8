"""Literal cases of names and texts."""
import re

from pyspark.sql import functions as F

from drawmark.functions import names, text


def rows(spark, values, **cols):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r.asDict() for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_replaced_names(spark):
    n = F.col("v")
    got = rows(spark, ["HYA116A226-1_Eg-脱敏-R.tif", "HB507795_C-脱敏-R.tiff", "HP101081A110-1_h-脱敏-R.TIF", "XYZ-R.tif", "HXYZ.tif",
                       "HYA116-R", "HXYZ-R.TIF", "HXYZ-R.png", "YA116A226-1_Eg-脱敏.tif", "edited"],
               stem=names.replaced_stem(n), original=names.original_name(n), replaced=names.is_replaced_name(n))
    assert [g["stem"] for g in got[:6]] == ["YA116A226-1_Eg-脱敏", "B507795_C-脱敏", "P101081A110-1_h-脱敏", "XYZ", "XYZ", "YA116"]
    assert [got[i]["original"] for i in (0, 1, 6, 7)] == ["YA116A226-1_Eg-脱敏.tif", "B507795_C-脱敏.tiff", "XYZ.TIF", "XYZ.tif"]
    assert [g["replaced"] for g in got] == [True, True, True, False, False, False, True, False, False, False]


def test_parsed_names(spark):
    parts = names.parsed_name(F.col("v"))
    got = rows(spark, ["dir/YA111111-1_eg.tif", "YA222222-2_FAILME.tif", "plain.pdf", "YA026D941_Rev2.pdf", "XA000001-R03.tif", "xb123456_V7.tif", "BB00001A-C.png", "A.B.YA123456.tif"], **parts)
    assert [g["drawing_no"] for g in got] == ["YA111111", "YA222222", "plain", "YA026D941", "XA000001", "XB123456", "BB00001A", "YA123456"]
    assert [g["revision"] for g in got] == ["N/A", "N/A", "N/A", "2", "03", "7", "C", "N/A"]
    assert [g["matched"] for g in got] == [True, True, False, True, True, True, True, True]


def test_stem_and_suffix(spark):
    got = rows(spark, ["a.tif", ".hidden", "dir.x/b", "c.d.PDF", "..e.txt", "f."], s=names.stem(F.col("v")), e=names.suffix(F.col("v")))
    assert [(g["s"], g["e"]) for g in got] == [("a", ".tif"), (".hidden", ""), ("b", ""), ("c.d", ".PDF"), ("..e", ".txt"), ("f", ".")]


def test_number_search_matches_plain_pattern(spark):
    import random
    random.seed(3)
    samples = ["".join(random.choices("YXBHKA019 -/", k=random.randint(0, 24))) for _ in range(3000)]
    plain = re.compile(r"[YXBH](?=[A-Z0-9]*\d)[A-Z0-9]{6,}")
    got = rows(spark, samples, number=text.first_number(F.col("v")))
    assert [g["number"] for g in got] == [m.group() if (m := plain.search(s)) else None for s in samples]


def test_repairs(spark):
    c = F.col("v")
    got = rows(spark, ["YAI28A36O", "YA07OA191P793E", "YA12", "1A128A36O", "YAO1B"], fixed=text.repair_digits(c))
    assert [g["fixed"] for g in got] == ["YA128A360", "YA070A191P793E", "YA12", "1A128A36O", "YAO1B"]
    got = rows(spark, ["YA0/6(C1", "TA02/C111", "AYA0123456", "YA01#2345", "YABC"], fixed=text.backfill_symbols(c))
    assert [g["fixed"] for g in got] == ["YA0160C1", "YA021C111", None, None, None]


def test_markup(spark):
    got = rows(spark, [r"\(x_{12}\)", r"a^{2}\alpha b", "{kept}", r"\[{k}\] "], cleaned=text.clean_markup(F.col("v")))
    assert [g["cleaned"] for g in got] == ["x12", "a2 b", "{kept}", "k"]


def test_vote_cuts_the_name_at_two_dots(spark):
    from drawmark.operators.votes import with_votes
    df = spark.createDataFrame([("YA123456.YB111111.tif", "YA999999", None), ("YA123456.tif", "yb 00001", "YB00001")], "file_name string, green_text string, orange_text string")
    got = [(r["file_vote"], r["voted"]) for r in with_votes(df).collect()]
    assert got == [("YA123456", "YA123456"), ("YA123456", "YB00001")]


def test_blanks_of_any_kind_are_cut_from_both_ends_only(spark):
    blanks = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    rows = [(f"{b}\n{b}Y{b}A{b}\r\n",) for b in blanks] + [("",), ("​Y",), ("\n 　",)]
    out = spark.createDataFrame(rows, "t string").select(text.strip(F.col("t"))).collect()
    assert [r[0] for r in out] == [f"Y{b}A" for b in blanks] + ["", "​Y", ""]


def test_found_is_evaluated_once(spark):
    numbers = spark.createDataFrame([("a YA123456",), ("none",)], "t string").select(text.found(text.first_number(F.col("t"))).alias("n"))
    plan = numbers._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1 and [r.n for r in numbers.collect()] == ["YA123456"]
