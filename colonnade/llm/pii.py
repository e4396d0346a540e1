"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score. SQL functions only.

The engine's regular expressions return matches without places, so a text is split at its matches too: the running
sums of the lengths of pieces and matches give the places, in code points. Sums run over blocks of few elements, and
sums of blocks over blocks again; what stands around a span is taken from the block of text that it is in. So the time
is in proportion to the text and its matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EMPTY = "cast(array() as array<struct<start:int,end:int,value:string>>)"
#: Elements whose sums run in one fold, and code points of a block of text.
_BLOCK, _CHARS = 64, 1024


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``pattern`` finds what the plain pattern of the kind finds, without backtracking
    into what it has read; ``hint`` is a cheap test that every text with a valid span passes."""

    name: str
    pattern: str
    hint: str
    valid: str
    score: float
    context: str


_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
#: Luhn: from the right, each second digit doubled, digits of the doubles summed.
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + if(i % 2 = 1, 1, 2) * cast(substr({_DIGITS}, -i, 1) as int)
  - if(i % 2 = 0 and cast(substr({_DIGITS}, -i, 1) as int) > 4, 9, 0)) % 10 = 0"""
_PLAIN = "replace(x.value, ' ', '')"
#: Mod 97: the first four characters go to the end, letters count from 10, the remainder must be 1.
_MOD97 = f"""aggregate(sequence(1, length({_PLAIN})), 0, (s, i) -> if(ascii(substr({_PLAIN}, 1 + (i + 3) % length({_PLAIN}), 1)) > 57,
  (s * 100 + ascii(substr({_PLAIN}, 1 + (i + 3) % length({_PLAIN}), 1)) - 55) % 97,
  (s * 10 + ascii(substr({_PLAIN}, 1 + (i + 3) % length({_PLAIN}), 1)) - 48) % 97)) = 1"""

#: Base kinds in the order of the result; what follows them is found beside them.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]", "true", 0.9, "mail|contact|write"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
         "rlike(x.value, '^(?:0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:[.]|$)){4}')", 0.6, "address|server|host|login"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?+[0-9]){12}",
         f"length({_DIGITS}) between 13 and 19 and {_LUHN}", 0.9, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", f"length({_DIGITS}) between 9 and 15", 0.7, "phone|call|tel|mobile"),
    # stands alone: no letter or digit before or after
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]",
         f"not rlike(x.before, '[A-Za-z0-9]$') and not rlike(x.after, '^[A-Za-z0-9]') and length({_PLAIN}) between 15 and 34 and {_MOD97}", 0.95, "iban|account|bank"),
)
BASE = ("email", "ip", "card", "phone")
#: Words that make a span less likely to be someone's data, and the characters around a span that are searched.
DOUBT, REACH = "example|sample|test|version|dummy", 40


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL for the body with a name for a value, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _folded(lengths: str) -> str:
    """SQL for the running sums within each block of an array of longs: an array of arrays."""
    blocks = f"transform(sequence(0, (size({lengths}) - 1) div {_BLOCK}), k -> slice({lengths}, k * {_BLOCK} + 1, {_BLOCK}))"
    return f"transform({blocks}, b -> aggregate(b, cast(array() as array<bigint>), (s, y) -> array_append(s, coalesce(get(s, size(s) - 1), 0L) + y)))"


def _ends(lengths: str) -> str:
    """SQL for the running sums of an array of longs that isn't empty."""
    before = f"if(k < {_BLOCK}, 0L, top[k div {_BLOCK} - 1]) + if(k % {_BLOCK} = 0, 0L, high[k div {_BLOCK}][k % {_BLOCK} - 1])"
    sums = f"flatten(transform(low, (b, k) -> {_let('base', before, 'transform(b, y -> y + base)')}))"
    # one number for _BLOCK * _BLOCK elements
    top = "transform(high, (b, i) -> aggregate(slice(high, 1, i + 1), 0L, (s, y) -> s + element_at(y, -1)))"
    return _let("n", lengths, _let("low", _folded("n"), _let("sums", "transform(low, b -> element_at(b, -1))", _let("high", _folded("sums"), _let("top", top, sums)))))


def _spans(kind: Kind) -> str:
    """SQL for array<struct<start, end, value>> of the kind's valid matches, from the columns m_ and p_ (matches, pieces)."""
    each = "named_struct('start', cast(e[i] as int) - length(m[i]), 'end', cast(e[i] as int), 'value', m[i], 'before', p[i], 'after', p[i + 1])"
    found = f"filter(transform(sequence(0, size(m) - 1), i -> {each}), x -> {kind.valid})"
    lengths = "zip_with(m, slice(p, 1, size(m)), (x, y) -> cast(length(x) + length(y) as bigint))"
    kept = f"transform({found}, x -> named_struct('start', x.start, 'end', x.end, 'value', x.value))"
    return f"if(size(m_{kind.name}) = 0, {_EMPTY}, {_let('m', f'm_{kind.name}', _let('p', f'p_{kind.name}', _let('e', _ends(lengths), kept)))})"


def _blocks(text: str) -> str:
    return f"regexp_extract_all({text}, '(?s).{{1,{_CHARS}}}', 0)"


def _piece(blocks: str, start: str, end: str) -> str:
    """SQL for the text from one place to another, from its blocks; what lies beyond the text is empty."""
    return f"substr(array_join(slice({blocks}, ({start}) div {_CHARS} + 1, ({end}) div {_CHARS} - ({start}) div {_CHARS} + 1), ''), ({start}) % {_CHARS} + 1, ({end}) - ({start}))"


def find_pii(docs: DataFrame, carry: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the carried columns and ``spans``, an array of (kind, start, end, value, score).

    Places count code points, ``end`` is exclusive; kinds come in the order of KINDS, then by start. The score is
    the kind's, higher by 0.1 if a context word of the kind stands within 40 characters, lower by 0.4 if a word
    such as "example" does. Null and empty texts have no spans; very long texts and ones full of matches take time in
    proportion; repeated rows are rows of their own; an empty table gives no rows; other columns, whatever their
    names, are not read.
    """
    out = docs.select(*[f"`{c}`" for c in carry], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    none = "cast(array() as array<string>)"
    for k in KINDS:
        out = out.withColumn(f"m_{k.name}", F.expr(f"if(rlike(__text, {_literal(k.hint)}), regexp_extract_all(__text, {_literal(k.pattern)}, 0), {none})"))
    for k in KINDS:
        out = out.withColumn(f"p_{k.name}", F.expr(f"if(size(m_{k.name}) = 0, {none}, split(__text, {_literal(k.pattern)}, -1))"))
    for k in KINDS:
        out = out.withColumn(f"v_{k.name}", F.expr(_spans(k)))
    scored = []
    for k in KINDS:
        score = f"round(greatest(0, least(1, {k.score} + if(rlike(near, '{k.context}'), 0.1, 0) - if(rlike(near, '{DOUBT}'), 0.4, 0))), 2)"
        near = f"lower({_piece('blocks', f'greatest(x.start - {REACH}, 0)', f'x.end + {REACH}')})"
        scored.append(f"transform(v_{k.name}, x -> named_struct('kind', '{k.name}', 'start', x.start, 'end', x.end, 'value', x.value, 'score', cast({_let('near', near, score)} as double)))")
    some = " + ".join(f"size(v_{k.name})" for k in KINDS)
    spans = _let("blocks", f"if({some} = 0, {none}, {_blocks('__text')})", f"concat({', '.join(scored)})")
    return out.select(*[f"`{c}`" for c in carry], F.expr(spans).alias("spans"))


def span_text(spans: Column | str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with each span of at least that score replaced by its kind in angle brackets; of overlapping spans the first goes. Null stays null."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = f"c{names.index(text)}"
    found = find_pii(plain, carry=tuple(plain.columns), text=own).withColumn("spans", F.expr(f"array_sort(filter(spans, s -> s.score >= {least}), (a, b) -> a.start - b.start)"))
    fold = f"""aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<string>)), (acc, s) -> if(s.start < acc.at, acc, named_struct('at', s.end,
      'out', array_append(acc.out, concat({_piece('blocks', 'acc.at', 's.start')}, '<', s.kind, '>')))),
      acc -> concat(array_join(acc.out, ''), {_piece('blocks', 'acc.at', f'length({own})')}))"""
    new = f"if(size(spans) = 0, {own}, {_let('blocks', _blocks(own), fold)})"
    found = found.withColumn(own, F.expr(f"if({own} is null, null, {new})"))
    return found.select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
