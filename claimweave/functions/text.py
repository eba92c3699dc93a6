"""Scalar functions over text, all of them Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and limits that results depend on.
QUOTE_LIMIT, QUOTE_HEAD, QUOTE_TAIL, ELLIPSIS = 350, 190, 140, " ... "
QUOTE_STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "for", "in", "on", "with", "is", "are", "be", "by", "that", "this",
    "상기", "및", "또는", "따라", "기초", "하는", "한다", "위한", "으로", "에서", "대한", "포함",
)
CLAIM_STOPWORDS = (
    "하는", "하고", "하며", "포함", "포함하는", "구비", "구비하는", "상기", "및", "또는", "위해", "위한", "방법", "장치", "시스템", "단계",
    "the", "and", "for", "with", "that", "this", "from", "into", "wherein",
)
BRACKETS_AND_MARKS = "[\\[\\]【】()（）,.;:\"'“”‘’<>]"
URL = r"(?i)https?://[^\s)<>\]]+"
DOCUMENT_ID = r"(?i)\b(?:US|WO|EP|KR|JP|CN)\s*[-/]?\s*\d{4,}[A-Z]\d?\b|\barXiv\s*:?\s*\d{4}\.\d{4,5}(?:v\d+)?\b|\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
MAX_KEYWORDS = 80
#: Technical clusters of elements in the order in which they are tried; the rest is generic.
CLUSTERS = {
    "control": "mode|control|controller|process|processing|determin|detect|decision|switch|select|convert|generate|output|adaptive|luminance|remosaic|binning|depth|제어|판단|검출|모드|처리|생성|출력|변환|선택|스위칭|적응",
    "sensor": "sensor|pixel|array|filter|photodiode|image sensor|센서|픽셀|어레이|필터|포토다이오드",
    "signal": "signal|data|readout|sampling|demultiplex|map|신호|데이터|샘플링|역다중화|맵",
    "mechanical": "motor|wheel|gear|shaft|hinge|구동축|기어|휠|모터|힌지",
    "io": "display|transmit|receive|interface|memory|storage|표시|송신|수신|인터페이스|메모리|저장",
}
GENERIC = "generic"


def _c(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def normalized_text(text: Column | str) -> Column:
    """Search form: brackets, quotes and stops become spaces, and runs of white space one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text), BRACKETS_AND_MARKS, " "), r"(?U)\s+", " "))


def element_cluster(text: Column | str) -> Column:
    """The first cluster that has a word in the text, else generic."""
    out = F.lit(GENERIC)
    for name, words in reversed(CLUSTERS.items()):
        out = F.when(_c(text).rlike(f"(?iu)(?:{words})"), name).otherwise(out)
    return out


def text_hash(text: Column | str) -> Column:
    return F.sha2(_c(text), 256)


def verbatim_text(text: Column | str) -> Column:
    """Form in which quotations are compared: words broken at line ends are joined, white space and case folded."""
    plain = F.regexp_replace(_c(text), " ", " ")
    joined = F.regexp_replace(plain, r"(?U)(?<=\w)-\s*\r?\n\s*(?=\w)", "")
    return F.lower(F.trim(F.regexp_replace(joined, r"(?U)\s+", " ")))


def folded(text: Column | str) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def shortened_quote(text: Column | str) -> Column:
    """At most QUOTE_LIMIT characters as they are, else a head and a tail cut at words."""
    q = F.regexp_replace(F.trim(_c(text)), "…", "...")
    head, tail = F.substring(q, 1, QUOTE_HEAD), F.right(q, F.lit(QUOTE_TAIL))
    head_cut = F.rtrim(F.regexp_replace(head, r"(?s) [^ ]*$", ""))
    tail_cut = F.ltrim(F.regexp_replace(tail, r"(?s)^[^ ]* ", ""))
    either = lambda cut, whole: F.when(cut != "", cut).otherwise(whole)
    return F.when(F.length(q) <= QUOTE_LIMIT, q).otherwise(F.concat(either(head_cut, head), F.lit(ELLIPSIS), either(tail_cut, tail)))


def quote_tokens(text: Column | str) -> Column:
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9가-힣]{2,}"), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, QUOTE_STOPWORDS)))


def reference_signs(text: Column | str) -> Column:
    """Distinct signs such as (12) or (104a), in order, at most thirty."""
    return F.slice(F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"\((\d{2,4}[a-zA-Z]?)\)"), F.lit(1))), 1, 30)


def figure_no(text: Column | str) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(_c(text), r"도\s*\d+[A-Za-z가-힣]?", 0), " ", ""), F.lit(""))


def has_hangul(text: Column | str) -> Column:
    return F.rlike(_c(text), F.lit("[가-힣]"))


def claim_keywords(text: Column | str, most: int = MAX_KEYWORDS) -> Column:
    """Distinct words of a claim without stopwords, in order, at most `most`."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9가-힣]{2,}|[ぁ-んァ-ヶー一-龯]{2,}"), F.lit(0))
    return F.slice(F.array_except(found, F.array(*map(F.lit, CLAIM_STOPWORDS))), 1, most)


def urls(text: Column | str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(text), F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;]+$", "")))


def document_ids(text: Column | str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(text), F.lit(DOCUMENT_ID), F.lit(0)), lambda u: F.upper(F.regexp_replace(u, " ", ""))))
