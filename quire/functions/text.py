"""Text functions and predicates as Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Phrases, patterns and tables that decide results.
APOLOGIES = (
    "i'm sorry", "im sorry", "sorry, i", "sorry i", "i apologize", "i apologise", "抱歉", "对不起", "對不起", "很抱歉",
)
REFUSALS = ("i cannot", "i can't", "i cant", "i am unable", "i'm unable", "as an ai", "as a language model")
DECLINING = (
    "cannot", "can't", "cant", "unable", "not able", "won't", "will not", "無法", "无法", "不能", "不會", "不会", "拒絕", "拒绝", "无法完成", "無法完成",
)
PUNCTUATION_LINE = r"(?U)^[\s…—–―·•*&^%$#@!~`´°¤§±×÷⇒→←↑↓│¦∗⊗∘\[\]{}()<>\\/|-]+$"
NUMBER_LINE = r"(?U)^[\s\d.,:;()\-–—〜~]+$"
PAGE_LINE = r"(?iU)^(page|p\.?|pp\.?)[\s\divxlc]+$"
ISBN_LINE = r"(?iU)^isbn[\s:\-–—]*[\d\-–—\sx]{8,}$"
DANGEROUS_SCHEMES = ("javascript:", "vbscript:", "data:text/html")
EXTERNAL_PREFIXES = ("data:", "http:", "https:", "//", "#", "mailto:", "tel:", "ftp:", "file:", "blob:")
NOTE_WORDS = ("footnote", "endnote", "rearnote", "ftn", "fn", "note")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LANGUAGES = {
    "auto": ("auto", "Auto"), "automatic": ("auto", "Auto"), "detect": ("auto", "Auto"),
    "en": ("en", "English"), "eng": ("en", "English"), "english": ("en", "English"),
    "zh": ("zh", "Chinese"), "chinese": ("zh", "Chinese"),
    "cn": ("zh-CN", "Simplified Chinese"), "zh-cn": ("zh-CN", "Simplified Chinese"), "zh_cn": ("zh-CN", "Simplified Chinese"),
    "zh-hans": ("zh-CN", "Simplified Chinese"), "zh_hans": ("zh-CN", "Simplified Chinese"),
    "simplified": ("zh-CN", "Simplified Chinese"), "simplified chinese": ("zh-CN", "Simplified Chinese"),
    "zh-tw": ("zh-TW", "Traditional Chinese"), "zh-hant": ("zh-TW", "Traditional Chinese"), "zh_hant": ("zh-TW", "Traditional Chinese"),
    "zh_tw": ("zh-TW", "Traditional Chinese"), "tw": ("zh-TW", "Traditional Chinese"),
    "traditional": ("zh-TW", "Traditional Chinese"), "traditional chinese": ("zh-TW", "Traditional Chinese"),
    "es": ("es", "Spanish"), "spanish": ("es", "Spanish"), "fr": ("fr", "French"), "french": ("fr", "French"),
    "de": ("de", "German"), "german": ("de", "German"), "ja": ("ja", "Japanese"), "japanese": ("ja", "Japanese"),
    "ko": ("ko", "Korean"), "korean": ("ko", "Korean"),
}
DEEPL_CODES = {
    "german": "DE", "english": "EN", "british english": "EN-GB", "american english": "EN-US", "spanish": "ES", "french": "FR",
    "italian": "IT", "dutch": "NL", "polish": "PL", "portuguese": "PT-PT", "brazilian portuguese": "PT-BR", "russian": "RU",
    "japanese": "JA", "chinese": "ZH", "simplified chinese": "ZH-HANS", "traditional chinese": "ZH-HANT", "korean": "KO",
}
CHINESE = r"[\u4e00-\u9fff]"


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def starts_with_any(value: Column, prefixes) -> Column:
    return any_of(value.startswith(p) for p in prefixes)


def contains_any(value: Column, parts) -> Column:
    return any_of(value.contains(p) for p in parts)


def collapse(value: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(value, r"(?U)[\s\x1c-\x1f]+", " "))


def not_blank(value: Column) -> Column:
    """Whether anything is left of a text by ``collapse``; read up to its first visible character."""
    return value.rlike(r"(?U)[^\s\x1c-\x1f]")


def dots(value: Column) -> Column:
    """Spaced full stops as ``...`` with exactly one space before what follows."""
    joined = F.regexp_replace(value, r"\.\s+\.\s+\.(\s+\.)*", "...")
    return F.regexp_replace(joined, r"\.\.\.\s*(?=\S)", "... ")


def spoken_dots(value: Column) -> Column:
    """Runs of at least three spaced full stops as ``...``."""
    once = F.regexp_replace(value, r"(\.\s+){2,}\.", "...")
    return F.regexp_replace(once, r"(\.\s+){2,}\.", "...")


def segment_id(stem: Column, xpath: Column) -> Column:
    return F.concat(stem, F.lit("-"), F.substring(F.sha1(xpath), 1, 12))


def rekeyed_segment_id(stem: Column, path: Column, xpath: Column) -> Column:
    """For ids that collide between files: the digest also covers the path."""
    return F.concat(stem, F.lit("-"), F.substring(F.sha1(F.concat(path, F.lit("\0"), xpath)), 1, 12))


def stem(path: Column) -> Column:
    """A file name without its directory and last extension."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def title_from_path(path: Column) -> Column:
    """A file's stem as a title: every run of letters begins with a capital."""
    words = F.split(F.lower(F.replace(stem(path), F.lit("_"), F.lit(" "))), r"(?U)(?<=\p{L})(?=[^\p{L}])|(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(words, F.initcap), "")


def _unless_empty(value: Column, other: str) -> Column:
    """``value``, or ``other`` where it is empty; its expression stands once in the plan, so a long text is worked through once."""
    return F.regexp_replace(value, r"\A\z", other)


def slug(title: Column, most: int = 50) -> Column:
    """A title as a file name. Hyphens at the end of what is cut off need no trimming of their own."""
    bare = F.trim(F.regexp_replace(title, r'[<>:"/\\|?*!]', ""))
    low = F.ltrim(F.lower(F.regexp_replace(bare, r"(?U)\s+", "-")), F.lit("-"))
    return _unless_empty(F.rtrim(F.substring(low, 1, most), F.lit("-")), "untitled")


def ascii_slug(title: Column) -> Column:
    """A title in ASCII letters, digits, underscores and hyphens. The class is spelled by its short name: with ranges it takes over four times as long."""
    return _unless_empty(F.regexp_replace(F.regexp_replace(F.trim(title), r"(?U)\s+", "_"), r"[^\w-]", ""), "audiobook")


def seconds(stamp: Column) -> Column:
    """``h:mm:ss(.fff)``, ``mm:ss`` or ``ss`` as seconds."""
    parts = F.reverse(F.split(stamp, ":"))
    at = lambda i: F.coalesce(F.get(parts, i).cast("double"), F.lit(0.0))
    return at(F.lit(0)) + 60 * at(F.lit(1)) + 3600 * at(F.lit(2))


def stamp(value: Column) -> Column:
    """Seconds as ``h:mm:ss``, with milliseconds where there are any."""
    h, m, s = F.floor(value / 3600), F.floor(value % 3600 / 60), value % 60
    whole = s == F.floor(s)
    return F.when(whole, F.format_string("%d:%02d:%02d", h, m, F.floor(s))).otherwise(F.format_string("%d:%02d:%06.3f", h, m, s))


def roman_table() -> list[tuple[str, int, str]]:
    """(numeral, value, words) for 1 to 50 and the tens up to 100."""
    small = "One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen Fourteen Fifteen Sixteen Seventeen Eighteen Nineteen".split()
    tens = ["Twenty", "Thirty", "Forty", "Fifty", "Sixty", "Seventy", "Eighty", "Ninety"]
    marks = ((100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))

    def roman(n: int) -> str:
        out = ""
        for value, mark in marks:
            while n >= value:
                out, n = out + mark, n - value
        return out

    def words(n: int) -> str:
        if n == 100:
            return "One hundred"
        if n < 20:
            return small[n - 1]
        return tens[n // 10 - 2] + ("-" + small[n % 10 - 1].lower() if n % 10 else "")

    return [(roman(n), n, words(n)) for n in [*range(1, 51), 60, 70, 80, 90, 100]]


def spoken_roman(value: Column, element: Column, order: Column) -> Column:
    """Roman numerals of headings, and of a file's first segment, as words."""
    pattern = r"(?i)^(?:(Chapter|Part|Book|Section)\s+)?([IVXLCDM]+)([.:\-—]?)$"
    bare = F.trim(value)
    pairs = [F.lit(x) for numeral, _, words in roman_table() for x in (numeral, words)]
    words = F.element_at(F.create_map(*pairs), F.upper(F.regexp_extract(bare, pattern, 2)))
    prefix = F.regexp_extract(bare, pattern, 1)
    said = F.concat(F.when(prefix != "", F.concat(prefix, F.lit(" "))).otherwise(F.lit("")), words, F.regexp_extract(bare, pattern, 3))
    applies = (element.isin(*HEADINGS) | (order == 1)) & bare.rlike(pattern)
    return F.when(applies, F.coalesce(said, value)).otherwise(value)


def no_words(value: Column) -> Column:
    """A text without any word character."""
    return value.rlike(r"(?U)^[^\w]+$")


def note_identifier(value: Column) -> Column:
    """Whether an id or class names a note by one of its parts, numbers aside."""
    parts = F.split(F.lower(value), r"[\s_\-]+")
    return F.exists(parts, lambda p: F.regexp_replace(p, r"[0-9]+$", "").isin(*NOTE_WORDS))


def heard(content: Column) -> Column:
    """A text with single spaces and ``...`` for spaced full stops, as it is read aloud."""
    return spoken_dots(collapse(content))


def speech_text(content: Column, element: Column, order: Column, ident: Column, xpath: Column) -> Column:
    """What of a text segment is spoken; null where nothing is."""
    return speech_of(heard(content), element, order, ident, xpath)


def speech_of(text: Column, element: Column, order: Column, ident: Column, xpath: Column) -> Column:
    """``speech_text`` of what ``heard`` has made; with that as a column of its own a text is worked through once."""
    marked = contains_any(F.lower(ident), ("ftn", "fn-", "note-", "endnote", "footnote"))
    boxed = any_of(F.lower(xpath).contains(f"div[@{a}='{w}") for a in ("id", "class") for w in ("footnote", "endnote", "notes"))
    silent = element.isin("table", "figure") | marked | boxed | (text == "") | no_words(text)
    return F.when(~silent, spoken_roman(text, element, order))


def copy_class(content: Column) -> Column:
    """Why a segment needs no model, else ``translate``."""
    text = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return (
        F.when(text == "", F.lit("empty"))
        .when(text.rlike(PUNCTUATION_LINE), F.lit("punctuation"))
        .when(text.rlike(NUMBER_LINE), F.lit("number"))
        .when(text.rlike(PAGE_LINE), F.lit("page"))
        .when(text.rlike(ISBN_LINE), F.lit("isbn"))
        .when((F.length(text) <= 3) & ~text.rlike(r"\p{L}"), F.lit("short"))
        .otherwise(F.lit("translate"))
    )


def refused(answer: Column, window: int = 400) -> Column:
    """Whether a model's answer declines the task: outright, or by an apology that also declines."""
    plain = F.translate(F.lower(collapse(F.coalesce(answer, F.lit("")))), "’`", "''")
    head = F.substring(plain, 1, window)
    return starts_with_any(head, REFUSALS) | (starts_with_any(head, APOLOGIES) & contains_any(head, DECLINING))


def chinese_target(language: Column) -> Column:
    low = F.lower(F.trim(language))
    return low.contains("chinese") | F.split(F.translate(low, "_", "-"), "-")[0].isin("zh", "cmn", "yue") | language.rlike(CHINESE)


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def language_code(value: Column) -> Column:
    key = F.lower(F.trim(value))
    return F.when(key == "", F.lit("auto")).otherwise(F.coalesce(_mapped({k: v[0] for k, v in LANGUAGES.items()}, key), F.trim(value)))


def language_name(code: Column) -> Column:
    named = {}
    for key, name in LANGUAGES.values():
        named.setdefault(key, name)
    return F.coalesce(_mapped(named, code), code)


def deepl_code(language: Column) -> Column:
    return _mapped(DEEPL_CODES, F.lower(language_name(language)))


def dangerous_url(url: Column) -> Column:
    bare = F.lower(F.regexp_replace(url, r"(?U)[\s\x00-\x1f]+", ""))
    return starts_with_any(bare, DANGEROUS_SCHEMES)


def external_url(url: Column) -> Column:
    return starts_with_any(F.lower(F.trim(url)), EXTERNAL_PREFIXES)


def keyword_match(value: Column, keywords) -> Column:
    """The first keyword, in their order, that a text holds: whole words in ASCII, parts of it otherwise."""
    text = F.lower(collapse(value))
    out = F.lit(None).cast("string")
    for word in reversed(list(keywords)):
        special = "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in word)
        hit = text.rlike(rf"(?U)(?<!\w){special}(?!\w)") if word.isascii() else text.contains(word)
        out = F.when(hit, F.lit(word)).otherwise(out)
    return out


def truncated(value: Column, most: int = 80) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 1), F.lit("…"))).otherwise(value)


def narrator(voice: Column) -> Column:
    """A voice's name: the part after language and region, without the usual endings."""
    parts = F.split(voice, "-")
    name = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 3, 1000), "-")).otherwise(voice)
    for ending in ("Neural", "Multilingual", "Turbo"):
        name = F.regexp_replace(name, ending + "$", "")
    name = F.btrim(name, F.lit("-_"))
    return F.when(name == "", voice).otherwise(name)


def sentences(value: Column, cjk: bool = False, abbreviations: Column | None = None) -> Column:
    """A text's sentences as an array; the CJK form also ends them without white space.

    A sentence doesn't end at one of ``abbreviations`` (lower case, without their last full stop); the parts are then joined by a space.
    """
    if cjk:
        parts = F.split(value, r"(?<=[。？！…；.!?])\s*")
    else:
        parts = F.split(value, r"(?<=[.!?…][\"'”’)]?)\s+")
    found = F.filter(parts, lambda p: F.trim(p) != "")
    if abbreviations is None:
        return found

    def told(last: Column) -> Column:
        """Whether a part ends at an abbreviation."""
        word = F.ltrim(F.lower(F.element_at(F.split(last, r"\s+"), -1)), F.lit("\"'“”‘’«»([{"))
        return word.endswith(".") & F.array_contains(abbreviations, F.substring(word, F.lit(1), F.length(word) - 1))

    def joined(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        whole = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.lit(" "), part)))
        return F.when(F.size(done) == 0, F.array(part)).when(told(last), whole).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(found, F.array().cast("array<string>"), joined)


def polish_cjk(value: Column) -> Column:
    """Spacing between Han and Latin text or digits, long dashes, and ellipses, in Chinese text."""
    han = r"\u4e00-\u9fff"
    out = F.regexp_replace(value, r"\s*\.\s+\.\s+\.(\s+\.)*\s*|\s*\.{3,}\s*", "... ")
    out = F.regexp_replace(out, rf"(?<=[{han}A-Za-z0-9）」』])\s*-{{2,}}\s*(?=[{han}A-Za-z0-9（「『])", " —— ")
    out = F.regexp_replace(out, rf"([{han}])([A-Za-z0-9])", "$1 $2")
    out = F.regexp_replace(out, rf"([A-Za-z0-9%℃°])([{han}])", "$1 $2")
    out = F.trim(F.regexp_replace(out, r" {2,}", " "))
    return F.when(value.rlike(CHINESE), out).otherwise(value)


def prompt(content: Column, mode: Column, source: Column, target: Column, intro: str) -> Column:
    """The request for one segment; ``intro`` may hold {language_instruction} and {mode_instruction}."""
    by_mode = F.when(mode == "html", F.lit("Preserve HTML structure in the translation.")).otherwise(
        F.lit("Return a faithful translation of the prose without adding explanations.")
    )
    from_, to = language_name(source), language_name(target)
    by_language = F.when(
        (source == "auto") | (F.lower(from_) == "auto"), F.concat(F.lit("Detect the source language automatically and translate it into "), to, F.lit("."))
    ).otherwise(F.concat(F.lit("Translate from "), from_, F.lit(" into "), to, F.lit(".")))
    text = F.lit(intro)
    for name, said in (("language_instruction", by_language), ("mode_instruction", by_mode), ("source_language", from_), ("target_language", to)):
        text = F.replace(text, F.lit("{" + name + "}"), said)
    return F.concat(F.trim(text), F.lit("\n\nSOURCE:\n"), content)


def concat_line(path: Column) -> Column:
    """A line of an ffmpeg concat list."""
    return F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def script_safe(json: Column) -> Column:
    """JSON that may stand inside a script element."""
    out = json
    for raw, safe in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
