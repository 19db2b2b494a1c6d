"""Sentence boundaries across languages and scripts, all in SQL expressions.

A text is cut into blocks at blank lines and around list lines; list lines and
numbered headings are one unit each. In the other blocks every full stop that
ends nothing (decimals, URLs, initials, abbreviations, ordinals, whatever
stands inside a quotation or bracket) is masked with a private-use character
of the same length, a boundary mark is put in by terminator patterns of the
scripts, and the block is split there. As masks keep the length, positions of
the pieces are positions in the text, from which the sentences are then read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.runtime import spread

# Private-use stand-ins. A text that holds them itself is read as if it held
# white space there; its sentences are cut from the text as it is.
CUT = "\ue000"  # a boundary
DOT = "\ue001"  # a masked full stop or other terminator
OPEN = "\ue002"  # an opening straight quote
CLOSE = "\ue003"  # a closing straight quote
INCH = "\ue004"  # an inch mark

# Abbreviations that never end a sentence.
BEFORE = [
    "p", "pp", "S", "Nr", "Fig", "Figs", "Tbl", "Vol", "Mk", "Rev", "Mfr", "Std", "Sec",
    "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec", "cf", "vs", "viz", "approx", "ca", "incl", "excl", "inkl", "exkl",
    "Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Messrs", "Gen", "Sr", "Sra", "Srta", "Mme", "Mlle",
    "Abb", "Kap", "Abs", "Vgl", "vgl", "bzw", "zzgl", "Bd", "Hr", "Fr", "Hrsg", "evtl", "ggf", "sog", "réf", "Réf", "ref", "Ref", "fig",
    "aprox", "núm", "Núm", "pág", "págs", "Pág", "стр", "рис", "Рис", "табл", "гл", "сов", "ул", "सं", "रु", "डॉ", "श्री",
]

# Words that are abbreviations only before a number, a numeral
# or a letter that names something.
NUMBERED = ["Ch", "Ed", "Eq", "Pt", "Art", "App", "Tab", "max", "min", "env", "art", "cap", "No", "Nos"]

# Abbreviations, units mostly, that may end a sentence: a capital
# or an opening after them starts the next one, small letters do not.
MAYBE = [
    "in", "ft", "lb", "lbs", "oz", "yd", "yds", "yrs", "yr", "hrs", "hr", "mins", "secs", "etc", "usw", "po", "pulg", "verz", "MwSt", "Stk", "Inc", "Ltd", "Co", "Corp", "mm", "cm", "kg",
    "шт", "руб", "коп", "г", "гг", "др", "пр", "тыс", "млн", "мин", "сек", "см",
]

# Abbreviations of two parts with a full stop each; blanks may
# stand between the parts. Those of the second list may end a sentence.
TWO = ["i.e", "e.g", "U.S", "z.B", "d.h", "u.a", "o.ä", "z.T", "v.a", "c.-à-d", "p.ej", "EE.UU", "т.е", "т.к"]
TWO_MAYBE = ["a.m", "p.m", "т.д", "т.п", "H.T", "मि.मी", "से.मी", "कि.ग्रा"]
# The same of three parts.
THREE = ["f.o.b", "i.d.R", "G.m.b"]

_WS = r"[\s\p{Z}]"
_TERM = ".!?…。！？｡．।॥؟۔"
_QUOTES = [("“„", "”“"), ("«", "»"), ("‹", "›"), ("「", "」"), ("『", "』"), ("‘", "’"), (OPEN, CLOSE)]
_CLOSERS = f"”’»›」』）】》〉\\)\\]{CLOSE}“"
_CASELESS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsArabic}\p{IsDevanagari}\p{IsThai}\p{IsHangul}\p{IsHebrew}"


def _rx(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, pattern, to)


def _where(text: Column, holds: str, change: Callable[[Column], Column]) -> Column:
    """The change, only for texts that match a pattern; others are left as they
    are, for the price of one search. The text is bound once, not repeated."""
    return F.element_at(F.transform(F.array(text), lambda x: F.when(x.rlike(holds), change(x)).otherwise(x)), 1)


def _mask_inside(text: Column, opening: str, closing: str) -> Column:
    """Mask the terminators inside pairs of marks of any length, but for those
    right before the closing mark. The text is cut at its marks into pieces;
    a running fold keeps how many marks are open before each, and a piece that
    ends in a closing mark, or lies between two marks, is inside if one is open
    and is closed later on. What is opened and never closed is no pair."""
    o, c = opening, closing
    inside = rf"[{_TERM}](?!{_WS}?[{_TERM}]*{_WS}?[{c}])"

    def pairs(x: Column) -> Column:
        # Pieces end with a mark, the last one with the text.
        pieces = F.regexp_extract_all(x, F.lit(rf"[^{o}{c}]*+[{o}{c}]|[^{o}{c}]++"), F.lit(0))
        ends = lambda p, m: p.rlike(rf"[{m}]\z")
        # From the right: how many closing marks wait for their opening one.
        closed = F.aggregate(
            F.reverse(pieces), F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")),
            lambda a, p: F.struct(F.when(ends(p, c), a["n"] + 1).when(ends(p, o), F.greatest(a["n"] - 1, F.lit(0))).otherwise(a["n"]).alias("n"), F.concat(a["at"], F.array(F.when(ends(p, c), a["n"] + 1).when(ends(p, o), F.greatest(a["n"] - 1, F.lit(0))).otherwise(a["n"]))).alias("at")),
            lambda a: F.reverse(a["at"]),
        )
        opened = F.aggregate(
            pieces, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")),
            lambda a, p: F.struct(F.when(ends(p, o), a["n"] + 1).when(ends(p, c), F.greatest(a["n"] - 1, F.lit(0))).otherwise(a["n"]).alias("n"), F.concat(a["at"], F.array(a["n"])).alias("at")),
            lambda a: a["at"],
        )
        masked = F.transform(F.arrays_zip(pieces.alias("p"), opened.alias("o"), closed.alias("c")), lambda z: F.when((z["o"] > 0) & (z["c"] > 0), _rx(z["p"], inside, DOT)).otherwise(z["p"]))
        return F.array_join(masked, "")

    return _where(text, rf"[{o}][^{c}]*+[{c}]", pairs)


def _parts(words: list[str]) -> str:
    return "|".join(r"\.\s?".join(w.split(".")) for w in words)


def _masked(block: Column) -> Column:
    t = block
    edge = r"(?<![\p{L}\p{M}\p{N}])"

    def direct(x: Column) -> Column:
        # Straight quotes get a direction; after a digit they are inch marks.
        x = _rx(x, r'"(?<=\d")(?=[\s\p{Z},;x×/.)-])', INCH)
        x = _rx(x, r'"(?<![^\s\p{Z}(\[{—–/-]")(?=[^\s\p{Z}])', OPEN)
        return _rx(x, '"', CLOSE)

    t = _where(t, '"', direct)
    t = _where(t, r"://|www\.", lambda x: _rx(x, r"((?:https?://|www\.)|\G(?!\A))([^\s.?!]*+)[.?!](?=[^\s\p{Z}])", f"$1$2{DOT}"))
    # Decimals, section and part numbers; stops inside a word.
    t = _rx(t, r"\.(?=\d)(?!(?<=\p{Ll}{3}\.)\d+ \p{L})|\.(?=\p{Ll})(?<=[\p{L}\p{N}]\.)", DOT)
    # Abbreviations of several parts, then single ones.
    two, maybe, three = _parts(TWO), _parts(TWO_MAYBE), _parts(THREE)
    part = r"([\p{L}\p{M}]+)\."
    t = _where(t, rf"(?:{three})\.", lambda x: _rx(x, rf"{edge}(?=(?:{three})\.){part}(\s?[^.]+)\.(\s?[^.]+)\.", f"$1{DOT}$2{DOT}$3{DOT}"))
    t = _rx(t, rf"{edge}(?=(?:{two})[.{DOT}]){part}(\s?[^.{DOT}]+)[.{DOT}]", f"$1{DOT}$2{DOT}")
    t = _rx(t, rf"{edge}(?=(?:{_parts(TWO_MAYBE).replace(chr(92) + '.', f'[.{DOT}]')})[.{DOT}])([\p{{L}}\p{{M}}]+)[.{DOT}](\s?[^.{DOT}]+)[.{DOT}](?!{_WS}+(?:\p{{Lu}}|[¿¡]))", f"$1{DOT}$2{DOT}")
    before = "|".join(sorted(set(BEFORE), key=len, reverse=True))
    t = _rx(t, rf"\.(?<=(?<![\p{{L}}\p{{M}}\p{{N}}{DOT}])(?:{before})\.)", DOT)
    numbered = "|".join(NUMBERED)
    t = _rx(t, rf"\.(?<=(?<![\p{{L}}\p{{M}}\p{{N}}{DOT}])(?:{numbered})\.)(?={_WS}+(?:\p{{Lu}}*\d|[IVXLC]+\b|(?![AI]\b)\p{{Lu}}\b))", DOT)
    # см. is "see", but centimetres after a number.
    t = _where(t, "[сС]м\\.", lambda x: _rx(x, rf"(?<![\p{{L}}\d])(?<!\d{_WS})(см|См)\.", rf"$1{DOT}"))
    # Units end a sentence only before what can start one.
    units = "|".join(sorted(MAYBE, key=len, reverse=True))
    starts = rf"{_WS}+[\"'“„«‘(\[{OPEN}¿¡]{{0,2}}(?:\p{{Lu}}|\p{{Ll}}\p{{Lu}}|\d|[{_CASELESS}])"
    t = _rx(t, rf"\.(?<=(?<![\p{{L}}\p{{M}}])(?:{units})\.)(?!{starts})(?=.)|\.(?<=\d{_WS}ft\.)(?={_WS}+\d)", DOT)
    # Initials: single capitals at the start, after a capitalised word or another initial.
    t = _rx(t, rf"\.(?<=(?:^|[{_TERM}{DOT}]{_WS}|\b\p{{Lu}}\p{{L}}{{1,20}}{_WS})\p{{Lu}}\.)(?={_WS}?\p{{Lu}}[\p{{Ll}}.])", DOT)
    # Ordinals, as in the 3. of March or the 27. edition.
    t = _rx(
        t,
        rf"\.(?<=\d\.)(?:(?<=\b(?:am|Am|dem|Dem|den|Den|der|Der|des|die|Die|das|Das|im|Im|vom|Vom|zum|Zum|zur|beim|bis|Bis|ab|Ab|seit|Seit|jeder){_WS}\d{{1,3}}\.)(?={_WS}+\p{{L}})"
        rf"|(?={_WS}+(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b))",
        DOT,
    )
    # What stands inside quotations and brackets. „…“ and “…” share a mark.
    t = _mask_inside(t, "“„", "”")
    t = _mask_inside(t, "„", "“")
    for o, c in [("«", "»"), ("‹", "›"), ("「", "」"), ("『", "』"), (OPEN, CLOSE), (r"(（", r")）"), (r"\[【", r"\]】")]:
        t = _mask_inside(t, o, c)
    return t


def _full_width(t: Column) -> Column:
    # Chinese speech after a colon ends its sentence, unless the text goes on.
    speech = rf"([：:]{_WS}?[“「『][^“”「」『』]*[。！？!?][”」』])(?=[^”’」』）》{CUT}])(?!{_WS}*(?:并|及|和|与|且|而|但|等|字样|的|と|っ|って|の))"
    t = _where(t, r"[：:][\s\p{Z}]?[“「『]", lambda x: _rx(x, speech, rf"$1{CUT}"))
    # Full-width terminators; a quotation that closes right after one goes on.
    t = _rx(t, rf"([。！？｡．]+)(?![。！？｡．”’」』）】》〉»{CLOSE}\)])", rf"$1{CUT}")
    t = _rx(t, rf"([。！？｡．!?]+[）\)】])(?![。！？，、；：,;])", rf"$1{CUT}")
    return _rx(t, rf"([。！？｡．]+[”’」』》〉»]+)(?={_WS}|[（“「『])", rf"$1{CUT}")


def _marked(masked: Column) -> Column:
    t = _where(masked, "[。！？｡．]", _full_width)
    # Dandas.
    t = _where(t, "[।॥]", lambda x: _rx(x, rf"([।॥]+)(?![।॥{_CLOSERS}])", rf"$1{CUT}"))
    # Stops before white space and something that can start a sentence.
    opening = rf"[\"'“„«‹‘(\[（「『{OPEN}¿¡*_]{{0,3}}{_WS}?"
    start = rf"(?:\p{{Lu}}|\p{{Lt}}|\p{{Ll}}\p{{Lu}}|\d|[±$€£§#•]|[{_CASELESS}])"
    t = _rx(t, rf"([.!?…؟۔]+)(?={_WS}+(?:{opening}{start}|[{_CASELESS}]))", rf"$1{CUT}")
    # Stops that lost the blank after them.
    t = _rx(t, rf"([.!?]+)(?<=[\p{{Ll}}\p{{N}}][.!?]{{1,3}})(?=[(“„{OPEN}]?\p{{Lu}}\p{{L}}|[(“„{OPEN}]\p{{L}}|\d)", rf"$1{CUT}")
    # After closing marks: capitals and digits start a sentence; scripts without
    # capitals go on after a quotation, and start anew after a bracket.
    close = rf"([.!?…؟।]+{_WS}?[{_CLOSERS}]+)(?={_WS}*{opening}(?:\p{{Lu}}|\p{{Lt}}|\p{{Ll}}\p{{Lu}}|\d|[¿¡$§]))"
    t = _rx(t, close, rf"$1{CUT}")
    t = _where(t, r"[.!?…؟।][\s\p{Z}]?[)\]）】]", lambda x: _rx(x, rf"([.!?…؟।]+{_WS}?[)\]）】]+)(?={_WS}+[{_CASELESS}])", rf"$1{CUT}"))
    t = _where(t, "[؟۔]", lambda x: _rx(x, rf"([؟۔])(?=[^\s\p{{Z}}{_CLOSERS}.!?؟۔{CUT}])", rf"$1{CUT}"))
    # Thai has no stops: a blank between two Thai letters ends a sentence.
    return _where(t, r"\p{IsThai}", lambda x: _rx(x, rf"([\p{{IsThai}}&&[^ๆฯ]])(?={_WS}+\p{{IsThai}})", rf"$1{CUT}"))


def _blocks(text: Column) -> Column:
    """The text in blocks: cut at blank lines and around list lines."""
    t = F.translate(text, CUT + DOT + OPEN + CLOSE + INCH, " " * 5)
    blank = r"[\s\p{Z}&&[^\n\r]]*"
    t = _rx(t, rf"(\r?\n)(?={blank}\r?\n)", rf"$1{CUT}")
    bullet = rf"{blank}(?:[•*‣◦▪●○·–-]{blank}(?<=[\s\p{{Z}}])|\(?\d{{1,3}}\)[ \t ]|\(?\p{{L}}\)[ \t ])"
    t = _rx(t, rf"(?m)^(?={bullet}\S)(.*)$", rf"{CUT}$1{CUT}")
    # Numbered headings and items stand at the start of a block.
    t = _rx(t, rf"(?m)^(?<=(?:\A|{CUT})[\s\p{{Z}}]{{0,20}})(?=\d{{1,3}}(?:\.\d{{1,3}}){{0,3}}\.?[ \t ]\S)(\d{{1,3}}\.[ \t ].*)$", rf"$1{CUT}")
    return F.split(t, CUT)


def sentence_units(text: Column) -> Column:
    """The units of a text as an array of (start_pos, end_pos), in characters."""
    listed = r"^[\s\p{Z}]*(?:[•*‣◦▪●○·–-][\s\p{Z}]|\(?\d{1,3}[.)][\s\p{Z}]|\(?\p{L}\)[\s\p{Z}])[^\n]*$"
    pieces = F.flatten(F.transform(_blocks(text), lambda b: F.when(F.length(F.trim(b)) == 0, F.array(b)).when(b.rlike(listed), F.array(b)).otherwise(F.split(_marked(_masked(b)), CUT))))
    # Each piece with where it starts: its length after the white space at its
    # ends is taken off, on a running total.
    sized = F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), F.length(F.regexp_replace(p, r"^[\s\p{Z}]+", "")).alias("l"), F.length(F.regexp_replace(p, r"[\s\p{Z}]+$", "")).alias("r")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start_pos:int,end_pos:int>>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        unit = F.struct((acc["at"] + p["n"] - p["l"]).alias("start_pos"), (acc["at"] + p["r"]).alias("end_pos"))
        return F.struct((acc["at"] + p["n"]).alias("at"), F.when(p["l"] > 0, F.concat(acc["found"], F.array(unit))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(sized, first, step)["found"]


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos, end_pos): every sentence of every document, positions in
    characters from 0, without surrounding white space. Null, empty and blank
    texts have none; a text without a terminator is one. No shuffle."""
    units = sentence_units(F.col(text))
    return spread(df.where(F.col(text).isNotNull()).select(key, text)).select(F.col(key), F.inline(units))
