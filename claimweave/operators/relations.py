"""Relations that a claim states in so many words and that its evidence must state too, as a table of rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_MISSING = 5

# Fixed values: (what the claim says, all of it; what the evidence must say, all of it; the limitation that is missing otherwise).
RULES = (
    (
        (r"변환", r"(?:좌표|제어\s*정보)"),
        (r"(?:변환|환산|매핑|좌표계\s*(?:변경|변환)|convert(?:s|ed|ing)?|transform(?:s|ed|ing|ation)?|coordinate\s+(?:system|axis).{0,80}(?:to|into)|mapping)",),
        "입력 정보를 카메라 제어 좌표 정보로 변환하는 명시적 처리 관계",
    ),
    (
        (r"설치\s*환경", r"오차.{0,12}보정|보정.{0,12}오차"),
        (
            r"(?:설치\s*(?:환경|상태|조건|위치)|설치된|배치된|현장\s*환경|환경\s*오차|상대\s*(?:위치|배치)|install(?:ation|ed)?|mount(?:ing|ed)?|position(?:ing|ed)?|relative\s+(?:position|location|orientation)|independently\s+positioned)",
            r"(?:보정|교정|보상|오차|편차|왜곡|compensat(?:e|es|ed|ing|ion)|calibrat(?:e|es|ed|ing|ion)|correct(?:s|ed|ing|ion)|alignment)",
            r"(?:좌표|좌표계|좌표축|coordinate|axis|pan\s+angle|tilt\s+angle)",
        ),
        "설치 환경에 따른 좌표 오차를 보정하는 명시적 처리 관계",
    ),
    (
        (r"현재\s*동작\s*상태", r"(?:여부를?\s*결정|여부\s*판단)"),
        (
            r"(?:동작\s*상태|현재\s*상태|operating\s+state|current\s+(?:state|mode)|idle|tracking\s+state).{0,140}(?:기초|따라|고려|입력|based\s+on|according\s+to|consider|depending\s+on)"
            r".{0,140}(?:방향\s*전환|여부|결정|판단|turn|switch|direction|determin|decid)",
        ),
        "카메라의 현재 동작 상태를 판단 입력으로 사용하여 방향 전환 여부를 결정하는 관계",
    ),
    (
        (r"결정\s*결과.{0,80}및.{0,80}출력값.{0,80}따라",),
        (r"(?:결정\s*결과|decision\s+(?:result|output))", r"(?:출력값|output\s+(?:value|result))", r"(?:함께|동시에|및|both|together|and).{0,120}(?:따라|기초|입력|based\s+on|according\s+to|input)"),
        "의사결정 결과와 좌표 보정부 출력값을 함께 입력하여 카메라를 제어하는 결합관계",
    ),
)


def _says(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & text.rlike("(?iU)" + p)
    return out


def unstated_relations(claim: Column, evidence: Column) -> Column:
    """The limitations of RULES that the claim states and the evidence does not, in the order of the rules.

    White space is folded first. Claims without a Hangul syllable state none; null texts count as empty.
    """
    said, held = [F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ") for c in (claim, evidence)]
    missing = F.array_compact(F.array(*[F.when(_says(said, own) & ~_says(held, other), F.lit(name)) for own, other, name in RULES]))
    return F.when(said.rlike("[가-힣]"), missing).otherwise(F.array().cast("array<string>"))


def relation_guard(claim: Column, evidence: Column, directness: Column, missing: Column) -> Column:
    """(directness, missing): unstated relations join the missing limitations, each once, while these are under five.

    Any unstated relation makes direct evidence inferred, whether or not the list had room for it. A null list counts as empty.
    """
    found = unstated_relations(claim, evidence)
    had = F.coalesce(missing, F.array().cast("array<string>"))
    fresh = F.filter(found, lambda x: ~F.array_contains(had, x))
    room = F.greatest(F.lit(MOST_MISSING) - F.size(had), F.lit(0))
    return F.struct(
        F.when((F.size(found) > 0) & (directness == "direct"), "inferred").otherwise(directness).alias("directness"),
        F.concat(had, F.slice(fresh, F.lit(1), room)).alias("missing"),
    )
