"""Text functions as column expressions: tokens, keywords, sets, sentiment, intensity, entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are taken off the ends of tags and names.
BLANKS = " \t\r\n\u3000\u00a0"
#: A token is a run of letters and digits; runs of Han characters are cut into pairs.
RUNS = r"(\p{IsHan}+|(?:[^\P{L}\p{IsHan}]|\p{N})+)"

# Words without meaning of their own, kept case-sensitive.
STOP_WORDS = (
    "这个 那个 什么 怎么 为什么 可以 没有 但是 如果 因为 所以 而且 然后 还是 就是 不是 一个 我们 你们 他们 已经 可能 应该 需要 这样 那样 这里 那里 这些 那些 之后 之前 时候 "
    "the this that what why how and but for with not are was had its has all can use get set "
    "的 了 在 是 我 有 和 就 不 人 都 一 上 也 很 到 说 要 去 你 会 着 看 好 自己 这"
).split()
# Words of feeling and their weights.
POSITIVE = {"太棒了": 1.5, "太好了": 1.5, "非常满意": 1.5, "爱了": 1.5, "绝了": 1.5, "牛逼": 1.5, "太强了": 1.5, "喜欢": 1.0, "不错": 1.0, "好用": 1.0, "满意": 1.0, "推荐": 1.0, "值得": 1.0, "好使": 1.0, "方便": 0.8, "清晰": 0.8, "直观": 0.8, "nice": 0.8, "good": 0.8, "great": 1.0, "awesome": 1.2, "excellent": 1.3}
NEGATIVE = {"太差了": 1.5, "垃圾": 1.5, "恶心": 1.5, "废物": 1.5, "烂": 1.3, "垃圾东西": 1.5, "讨厌": 1.0, "不好用": 1.0, "不满意": 1.0, "糟糕": 1.0, "烦": 0.8, "失望": 1.0, "差评": 1.0, "不行": 0.8, "bad": 1.0, "terrible": 1.3, "hate": 1.2, "useless": 1.0}
NEGATORS = ("不", "没", "别", "勿", "无", "not", "no", "n't", "never")
# Adverbs of degree, and the words that decide the sign of an intensity.
ADVERBS = ("太", "超", "极", "巨", "贼", "老", "特", "爆", "非常", "极其", "超级", "格外", "分外", "过于", "无比", "绝顶", "十分", "相当", "特别", "完全", "根本", "彻底", "绝对", "真的", "真是", "简直", "实在", "到底", "究竟", "明明")
LABEL_POSITIVE = ("喜欢", "不错", "满意", "nice", "good", "great", "太棒", "爱了", "绝了", "牛逼", "推荐", "值得")
LABEL_NEGATIVE = ("垃圾", "恶心", "讨厌", "烂", "烦", "失望", "差", "bad", "terrible", "hate", "useless", "废物")
LABEL_NEGATORS = ("没", "别", "勿", "无", "not", "no", "never")
# Entities known by name, technical terms, endings of organisations.
KNOWN_ENTITIES = ("缠论", "中枢", "三买", "三卖", "顶背驰", "底背驰", "金叉", "死叉", "以太坊", "比特币", "知乎", "B站", "抖音", "微博", "公众号", "视频号", "微信", "QQ", "Telegram", "币安", "Bitget", "Binance", "小红书")
TECHNICAL = ("ZG", "ZD", "MACD", "DIF", "DEA", "HIST", "RSI", "OBV", "EMA", "SMA", "BOLL", "buy1", "sell1", "buy2", "sell2")
ORGANISATIONS = ("公司", "平台", "集团", "科技", "网络", "学院", "大学", "社区", "基金", "项目", "团队", "部门")
# Abbreviations that end no sentence.
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr st vs etc dept inc ltd co corp capt gen sgt lt maj col gov rep sen pres vice hon esq phd md ave blvd rd ct est inst univ "
    "a b c d e f g h i j k l m n o p q r s t u v w x y z jan feb mar apr jun jul aug sep oct nov dec al fig vol no pp ex"
).split()


def strip(c: Column) -> Column:
    """A string without the blanks around it."""
    return F.btrim(c, F.lit(BLANKS))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokens(c: Column) -> Column:
    """Tokens in order, in lower case; none of a null."""
    runs = F.regexp_extract_all(F.lower(_text(c)), F.lit(RUNS), F.lit(1))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^\p{IsHan}{2,}$"), pairs(r)).otherwise(F.array(r))))


def _words(words) -> Column:
    """A constant list, by few calls; it is folded to a literal."""
    return F.split(F.lit("|".join(words)), r"\|")


def content_terms(c: Column) -> Column:
    """Tokens that may carry meaning: two characters or more, no stop word, not only digits."""
    stop = _words(STOP_WORDS)
    return F.filter(tokens(c), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t) & ~t.rlike(r"^\p{N}+$"))


def keyword_occurrences(c: Column) -> Column:
    """Candidates for keywords, in order: content terms of more than one distinct character, and once more each word of three or more letters a-z."""
    low = content_terms(c)
    varied = F.filter(low, lambda t: F.size(F.array_distinct(F.split(t, ""))) > 1)
    words = F.regexp_extract_all(F.lower(_text(c)), F.lit(r"(?<![\p{L}\p{N}_])([a-z]{3,})(?![\p{L}\p{N}_])"), F.lit(1))
    stop = _words(STOP_WORDS)
    return F.concat(varied, F.filter(words, lambda t: ~F.array_contains(stop, t) & (F.size(F.array_distinct(F.split(t, ""))) > 1)))


def ngrams(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams; none of a shorter text."""
    text = _text(c)
    return F.array_distinct(F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two lists taken as sets; 0 if either is empty or null."""
    a, b = (F.array_distinct(F.coalesce(x, F.array().cast("array<string>"))) for x in (a, b))
    same = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / (F.size(a) + F.size(b) - same))


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def _feeling(low: Column, words: dict[str, float]) -> tuple[Column, Column]:
    """Weights of the words that stand plainly, and of those that a negator turns (at half weight); first places only."""
    plain, turned = F.lit(0.0), F.lit(0.0)
    for w, weight in words.items():
        at = F.instr(low, w)
        start = F.greatest(at - 4, F.lit(1))
        before = F.substring(low, start, at - start)
        negated = before.rlike("|".join(NEGATORS))
        plain += F.when((at > 0) & ~negated, weight).otherwise(0.0)
        turned += F.when((at > 0) & negated, weight * 0.5).otherwise(0.0)
    return plain, turned


def sentiment(c: Column) -> Column:
    """Polarity from -1 to 1."""
    low = F.lower(_text(c))
    positive, turned_positive = _feeling(low, POSITIVE)
    negative, turned_negative = _feeling(low, NEGATIVE)
    p, n = positive + turned_negative, negative + turned_positive
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (p - n) / F.greatest(p + n, F.lit(0.1)))), 6)


def sentiment_label(polarity: Column) -> Column:
    return F.when(polarity > 0.15, "positive").when(polarity < -0.15, "negative").otherwise("neutral")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def intensity(c: Column) -> Column:
    """Emotional intensity from 0 to 2, of marks, adverbs, repetition, capitals and questions."""
    raw = F.trim(_text(c))
    mixed = F.regexp_extract_all(raw, F.lit("([!?！？]{2,})"), F.lit(1))
    marks = F.least((_count(raw, "!{2,}") + _count(raw, r"\?{2,}") + F.size(mixed)) * 0.15, F.lit(0.6))
    both = F.size(F.filter(mixed, lambda m: F.contains(m, F.lit("!")) & F.contains(m, F.lit("?")))) * 0.2
    adverbs = F.least(F.size(F.filter(_words(ADVERBS), lambda a: F.contains(raw, a))) * 0.2, F.lit(0.6))
    chars = F.least(_count(raw, r"(?d)(.)\1{2,}") * 0.15, F.lit(0.3))
    words = F.least(_count(raw, r"(?d)(.{2,4})\1{1,}") * 0.2, F.lit(0.4))
    capitals = F.least(_count(raw, r"(?<![\p{L}\p{N}_])[A-Z]{3,}(?![\p{L}\p{N}_])") * 0.15, F.lit(0.3))
    questions = _count(raw, "[?？]")
    asked = F.when(questions >= 2, F.least((questions - 1) * 0.1, F.lit(0.3))).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(2.0), marks + both + adverbs + chars + words + capitals + asked)), 4)


def intensity_label(c: Column, strength: Column) -> Column:
    low = F.lower(F.trim(_text(c)))
    any_of = lambda words: low.rlike("|".join(words))
    negated = any_of(LABEL_NEGATORS) | (F.contains(low, F.lit("不")) & ~F.contains(low, F.lit("不错")))
    strong = lambda label: F.when(strength >= 1.2, f"strong_{label}").otherwise(label)
    return F.when(low == "", "neutral").when(any_of(LABEL_POSITIVE) & ~negated, strong("positive")).when(any_of(LABEL_NEGATIVE) | negated, strong("negative")).otherwise("neutral")


def entities(c: Column) -> Column:
    """Entities by lists and form: known names, capitals, technical terms, what stands before an organisation's ending, prices. Distinct without regard to case, in this order."""
    text = _text(c)
    low = F.lower(text)
    has = lambda words: F.filter(_words(words), lambda w: F.contains(low, F.lower(w)))
    capitals = F.regexp_extract_all(text, F.lit("([A-Z][A-Z0-9]+(?:/[A-Z0-9]+)*)"), F.lit(1))
    before = F.regexp_extract_all(text, F.lit(r"(\p{IsHan}{2})(?:" + "|".join(ORGANISATIONS) + ")"), F.lit(1))
    prices = F.regexp_extract_all(text, F.lit(r"(?<!\d)([6-9]\d{4,5})(?!\d)"), F.lit(1))
    every = F.concat(has(KNOWN_ENTITIES), capitals, F.transform(has(TECHNICAL), F.upper), before, prices)
    lows = F.transform(every, F.lower)
    return F.filter(every, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1)


def is_abbreviation(c: Column) -> Column:
    """Whether a text ends in an abbreviation's full stop."""
    word = F.regexp_extract(F.lower(_text(c)), r"([a-z]{1,5})\.$", 1)
    return F.coalesce(word.isin(*ABBREVIATIONS), F.lit(False))


def ends_with_numeral(c: Column) -> Column:
    """Whether a text ends in a digit and a full stop."""
    return _text(c).rlike(r"[0-9]\.$")
