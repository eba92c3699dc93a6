"""Sets of claims against a plain loop over lines, and the relation rules one by one."""

import random
import re

from pyspark.sql import functions as F

from claimweave.operators import claim_sets, relations

HEAD = [re.compile(p) for p in claim_sets.INLINE_HEADERS + claim_sets.LINE_HEADERS]


def by_loop(text):
    """The claims of one text: the header seen last and the claim that is open are all that the loop keeps."""
    text = (text or "").strip()
    claims, seen, current = [], None, None
    for line in text.split("\n"):
        m = next((m for m in (p.match(line.strip()) for p in HEAD) if m), None)
        if m:
            number, goes_on = int(m[1]), seen is None or int(m[1]) > seen
            seen = number
            if goes_on:
                current = [m[2] if m.lastindex > 1 else ""]
                claims.append((number, current))
                continue
        if current is not None:
            current.append(line)
    out = [(n, "\n".join(ls).strip()) for n, ls in claims]
    out = [c for c in out if c[1]]
    if out:
        return out
    parts, part = [], []
    for line in text.split("\n"):
        if re.match(r"(청구항\s*)?[0-9]+[.．][ \t]", line):
            parts.append(part)
            part = []
        part.append(line)
    parts = [p for p in ("\n".join(ls).strip() for ls in parts + [part]) if p]
    if len(parts) > 1:
        out = [(int(m[1]), p[m.end():].strip()) for p in parts if (m := re.match(r"(?:청구항\s*)?([0-9]+)[.．][ \t]*", p))]
    return out or ([(1, text)] if text else [])


def test_sets_equal_a_loop(spark):
    rng = random.Random(5)
    forms = ["청구항 {}", " 제{}항. ", "【청구항 {}】", "【 청구항{} 】. 빛을 내는", "[CLAIM {}] a lamp", "[claim {}]", "{}. a lamp", "청구항 {}． 장치", "제 {} 항에 있어서, 장치", "청구항 {}에 있어서", "a lamp", "", "  of 2. parts", "{}.5 mm"]
    texts = [None, "", " \n ", "청구항 1", "a\n청구항 2\n청구항 1\nb", "1. a", "x\n1. a", "1. \n2. b", "청구항 3\na\n청구항 1\nb\n청구항 2\nc\n청구항 2\nd", "[claim 99999999999999999999]\na", "1. a\n1. b\n0. c"]
    texts += ["\n".join(rng.choice(forms).format(rng.randint(1, 9)) for _ in range(rng.randint(1, 14))) for _ in range(500)]
    texts.append("\n".join(f"청구항 {i}\nlamp {i}" for i in range(1, 3001)))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("claims", F.lit(0)).withColumn("place", F.lit(9))
    got = {}
    for r in claim_sets.split_claims(df, ["id"]).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["claim_number"], r["text"]))
    for i, t in enumerate(texts):
        want = [] if t and "9" * 20 in t else by_loop(t)
        assert got.get(i, []) == (want or ([(1, t)] if t and t.strip() else [])), t
    assert claim_sets.split_claims(df.limit(0), ["id"]).count() == 0


def test_dependence(spark):
    said = {"제 1 항에 있어서, 장치": True, "청구항 2에 있어서": True, "제1항 내지 제3항 중 어느 한 항에 있어서": True, "청구항 1 내지 3 중 어느 한 항에 있어서": True, "청구항 1 또는 청구항 2에 있어서": True, "제1항의 장치": False, "": False, None: False}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", claim_sets.is_dependent(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == said


def test_each_rule_fires_and_holds(spark):
    stated = [
        ("입력을 좌표로 변환", "입력을 매핑", "입력을 수신", 0),
        ("설치 환경에 따라 오차를 보정", "설치 위치의 좌표를 교정", "설치 위치의 교정", 1),
        ("현재 동작 상태로 여부 판단", "현재 상태에 따라 방향 전환", "방향 전환은 현재 상태에 따라", 2),
        ("결정 결과 및 출력값에 따라", "decision result and output value, together used as input", "decision result, output value", 3),
    ]
    names = [r[2] for r in relations.RULES]
    rows = [(i, c, e, bad) for i, (c, good, other, _) in enumerate(stated) for e, bad in ((good, False), (other, True), (None, True))]
    df = spark.createDataFrame(rows, "i int, c string, e string, bad boolean").withColumn("directness", F.lit("direct"))
    out = df.select("*", relations.relation_guard(F.col("c"), F.col("e"), F.col("directness"), F.lit(None).cast("array<string>")).alias("g")).collect()
    for r in out:
        assert r["g"]["missing"] == ([names[r["i"]]] if r["bad"] else []), (r["c"], r["e"])
        assert r["g"]["directness"] == ("inferred" if r["bad"] else "direct")


def test_guard_keeps_to_its_room(spark):
    claim = "좌표 변환, 현재 동작 상태로 여부 판단"
    rows = [(claim, 4, "direct"), (claim, 5, "direct"), (claim, 6, "absent"), (claim, 0, None), ("coordinate 변형", 0, "direct"), (None, 1, "direct")]
    df = spark.createDataFrame(rows, "c string, n int, d string").withColumn("m", F.transform(F.expr("slice(sequence(0, n), 1, n)"), lambda i: F.concat(F.lit("m"), i.cast("string"))))
    out = df.select("n", relations.relation_guard(F.col("c"), F.lit(""), F.col("d"), F.col("m")).alias("g")).collect()
    assert [(r["g"]["directness"], len(r["g"]["missing"])) for r in out] == [("inferred", 5), ("inferred", 5), ("absent", 6), (None, 2), ("direct", 0), ("direct", 1)]
    had = spark.range(1).select(relations.relation_guard(F.lit(claim), F.lit(""), F.lit("direct"), F.array(F.lit(relations.RULES[0][2]))).alias("g")).first()["g"]
    assert had["missing"] == [relations.RULES[0][2], relations.RULES[2][2]]
