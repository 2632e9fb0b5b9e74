"""Scalar functions on text, URLs, dates and hashes. Columns in, columns out; Arrow only where Spark has no built-in."""

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Terms, negations and rule families of the default lexicon and labelling rules.
POSITIVE_TERMS = ("創新高", "優於預期", "超越預期", "上調", "調升", "成長", "增加", "改善", "獲利", "盈餘", "轉虧為盈", "重大訂單",
                  "需求強勁", "提前償債", "提高股利")
NEGATIVE_TERMS = ("虧損", "低於預期", "不如預期", "下修", "調降", "衰退", "下滑", "減少", "惡化", "停工", "裁員", "罰款", "減損",
                  "違約", "流失", "需求疲弱")
NEGATIONS = ("未", "沒有", "並未", "不會", "無")
EVENT_TERMS = {
    "EARNINGS": ("財務報告", "稅後淨利", "每股盈餘", "虧損"), "REVENUE": ("月營收", "營業收入", "合併營收"),
    "DIVIDEND": ("現金股利", "股票股利", "盈餘分配", "除權息"), "BUYBACK": ("庫藏股", "買回股份"),
    "CAPITAL_INCREASE": ("現金增資", "私募", "發行新股"), "CAPITAL_REDUCTION": ("減資", "退還股款"),
    "MERGERS_AND_ACQUISITIONS": ("合併案", "股份轉換", "收購"), "REGULATORY": ("主管機關", "裁罰", "行政處分", "重大訴訟"),
    "MANAGEMENT_CHANGE": ("董事長異動", "總經理異動", "發言人異動"), "GUIDANCE": ("財務預測", "營運展望", "未來展望"),
    "MATERIAL_TRANSACTION": ("重大合約", "取得或處分資產", "背書保證", "資金貸與"),
}
RULE_POSITIVE = ("營收成長", "獲利增加", "取得重大訂單", "轉虧為盈")
RULE_NEGATIVE = ("營收衰退", "獲利減少", "發生虧損", "遭裁罰", "停工", "終止合約")
TRACKING_KEYS = ("fbclid", "gclid", "utm_campaign", "utm_content", "utm_medium", "utm_source")
SEPARATOR = "\x1f"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


@F.pandas_udf(DoubleType())
def sim_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The ratio of matching blocks; 0 if either side is empty."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right, strict=True)])


def norm_title(title: Column) -> Column:
    return F.regexp_replace(folded(title), r"[^\p{L}\p{N}\p{M}_]+", "")


def fingerprint(title: Column) -> Column:
    return F.sha2(norm_title(title), 256)


def norm_ticker(text: Column) -> Column:
    """Null where the result is no ticker."""
    plain = F.upper(F.regexp_replace(F.trim(text), "^'", ""))
    plain = F.regexp_replace(plain, r"\.(TWO|TW)$", "")
    return F.when(plain.rlike("^[0-9A-Z]{1,10}$"), plain)


def supports_language(lang: Column, prefixes: tuple[str, ...]) -> Column:
    low = F.lower(lang)
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | (low == p.lower()) | low.startswith(p.lower() + "-")
    return F.coalesce(hit, F.lit(False))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking keys, sorted pairs, no slash at the path's end. Pairs keep
    their percent signs as they are."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    pairs = F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: p != "")
    kept = F.filter(pairs, lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING_KEYS))
    joined = F.array_join(F.array_sort(kept), "&")
    return F.concat(head, path, F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined)))


def stable_id(*columns: Column) -> Column:
    """SHA-256 of the parts, nulls as empty strings, with a separator that no part contains."""
    return F.sha2(F.concat_ws(SEPARATOR, *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def row_hash(*columns: str) -> Column:
    """SHA-256 of the row as JSON, fields by name, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def norm_text(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t　]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(out, r"^\n+|\n+$", ""))


def norm_line(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def excerpt(html: Column, n: int = 500) -> Column:
    """Text of a page, at most n characters; null if there is none."""
    plain = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</\1>", " ")
    plain = F.regexp_replace(plain, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.nullif(F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, n), F.lit(""))


def parse_roc_date(text: Column) -> Column:
    """Years count from 1911; separators or seven or eight digits; null where that is no date."""
    digits = F.regexp_replace(F.trim(text), r"^([0-9]{2,4})[/.-]([0-9]{1,2})[/.-]([0-9]{1,2})$", "$1-$2-$3")
    compact = F.regexp_replace(digits, r"^([0-9]{3,4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    parts = F.split(compact, "-")
    year = F.try_element_at(parts, F.lit(1)).try_cast("int")
    year = F.when(year < 1000, year + 1911).otherwise(year)
    iso = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(F.try_element_at(parts, F.lit(2)), 2, "0"), F.lpad(F.try_element_at(parts, F.lit(3)), 2, "0"))
    return F.when(F.size(parts) == 3, iso.try_cast("date"))


def quantised(value: Column, places: int) -> Column:
    """Half to even, without a negative zero."""
    out = F.bround(value, places)
    return F.when(out == 0, F.lit(0.0)).otherwise(out)


def runs(text: Column, k: int) -> Column:
    """Every run of ``k`` characters, one from each place, in one pass over the text; none where it is shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def shingles(text: Column, k: int) -> Column:
    """The different runs of ``k`` characters of the text without white space; null text has none."""
    return F.array_distinct(runs(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), k))


def mentions(text: Column, ticker: Column) -> Column:
    return F.rlike(text, F.concat(F.lit("(?<![A-Za-z0-9])"), ticker, F.lit("(?![A-Za-z0-9])")))


def term_score(text: Column, terms: tuple[str, ...], negations: tuple[str, ...]) -> Column:
    """Occurrences of the terms, those after a negation against it."""
    before = "|".join(negations)
    total = F.lit(0)
    for t in terms:
        total = total + F.regexp_count(text, F.lit(f"(?<!(?:{before})){t}")) - F.regexp_count(text, F.lit(f"(?<=(?:{before})){t}"))
    return total.cast("double")


def lexicon_sentiment(text: Column, positive=POSITIVE_TERMS, negative=NEGATIVE_TERMS, negations=NEGATIONS) -> Column:
    """Struct (pos, neu, neg): a softmax of the scores, neutral favoured on a tie."""
    up, down = term_score(text, positive, negations), term_score(text, negative, negations)
    middle = F.when(up == down, up + 1).otherwise(0.0)
    top = F.greatest(up, middle, down)
    a, b, c = (F.exp(x - top) for x in (up, middle, down))
    return F.struct((a / (a + b + c)).alias("pos"), (b / (a + b + c)).alias("neu"), (c / (a + b + c)).alias("neg"))


def cue_terms(text: Column, terms: tuple[str, ...]) -> Column:
    return F.array_sort(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)))


def rule_vote(text: Column, families: dict[str, tuple[str, ...]] = EVENT_TERMS, positive=RULE_POSITIVE, negative=RULE_NEGATIVE) -> Column:
    """Struct (event_type, impact, confidence, reason): an event type if exactly one family hits."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    holds = lambda terms: plain.rlike("|".join(terms))
    hit = F.array_compact(F.array(*(F.when(holds(t), F.lit(n)) for n, t in families.items())))
    up, down = holds(positive), holds(negative)
    impact = F.when(up & down, "AMBIGUOUS").when(up, "POSITIVE").when(down, "NEGATIVE")
    event = F.when(F.size(hit) == 1, F.element_at(hit, 1))
    signal = impact.isNotNull() | event.isNotNull()
    return F.struct(event.alias("event_type"), impact.alias("impact"), F.when(signal, 0.8).otherwise(0.0).alias("confidence"),
                    F.when(~signal, "NO_RULE_MATCH").alias("reason"))


def model_text(title: Column, summary: Column) -> Column:
    t, s = F.trim(title), F.trim(F.coalesce(summary, F.lit("")))
    return F.when((s == "") | (s == t), t).otherwise(F.concat_ws("\n", t, s))


def norm_entropy(counts: Column) -> Column:
    """Entropy of an array of non-negative weights over the logarithm of their number; 0 for fewer than two."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    raw = F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.ln(x / total)).otherwise(0.0))
    used = F.size(F.filter(counts, lambda x: x > 0))
    return F.when(counts.isNotNull(), F.when(used > 1, raw / F.ln(used.cast("double"))).otherwise(0.0))


def meta(column: Column, key: str) -> Column:
    return F.nullif(F.trim(F.get_json_object(column, f"$.{key}")), F.lit(""))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def marker_flags(text: Column) -> Column:
    return F.struct(
        text.rlike(r"[一-鿿]").alias("han"), text.rlike(r"[0-9]").alias("digits"), text.rlike(r"(?i)https?://").alias("url"),
        text.rlike(r"[#*$%&|]{3}").alias("symbols"),
    )
