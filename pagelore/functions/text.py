"""Text as column expressions: white space, error rates, failure classes, repair of text and of LaTeX, escaping."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)\s"


def normalize_whitespace(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at either end."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip_whitespace(text: Column) -> Column:
    """All Unicode white space removed."""
    return F.regexp_replace(text, SPACE, "")


def is_blank(text: Column) -> Column:
    return ~F.regexp_like(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S"))


def rate_of(distance: Column, expected: Column, actual: Column) -> Column:
    """Edit distance over length, in code points. With nothing expected: 0 if nothing came, else 1."""
    n = F.char_length(expected)
    return F.when(n == 0, F.when(F.char_length(actual) == 0, 0.0).otherwise(1.0)).otherwise(distance.cast("double") / n)


def error_rate(expected: Column, actual: Column) -> Column:
    return rate_of(F.levenshtein(expected, actual), expected, actual)


def page_error_rate(expected: Column, actual: Column) -> Column:
    """Error rate of a page: white space normalised, single precision."""
    return error_rate(normalize_whitespace(expected), normalize_whitespace(actual)).cast("float")


def text_metrics(expected: Column, actual: Column) -> Column:
    """struct<exact,normalized,distance,cer>"""
    return F.struct(
        (expected == actual).alias("exact"),
        (strip_whitespace(expected) == strip_whitespace(actual)).alias("normalized"),
        F.levenshtein(expected, actual).cast("long").alias("distance"),
        error_rate(expected, actual).alias("cer"),
    )


#: Names of failure kinds, those of the pipeline and those of the model.
FAILURES = ("none", "image_decode", "inference", "tokenizer_decode", "input_rejected", "truncated_no_eos", "model_mismatch", "empty_ground_truth")
PIPELINE_FAILURES = ("image_decode", "inference", "tokenizer_decode", "input_rejected")
MODEL_FAILURES = ("model_mismatch", "truncated_no_eos")
#: The failure that each class of error counts as.
ERROR_FAILURES = {
    "invalid_image": "image_decode", "file_not_found": "image_decode", "download": "image_decode", "io": "image_decode", "http": "image_decode",
    "tokenizer": "tokenizer_decode", "decode": "inference",
    "invalid_input": "input_rejected", "config": "input_rejected", "unsupported_provider": "input_rejected", "unsupported_backend": "input_rejected",
    "hash_mismatch": "input_rejected", "model_resolve": "input_rejected", "yaml": "input_rejected",
}


def error_failure(error: Column) -> Column:
    """The failure kind of a class of error; null for one that isn't known."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ERROR_FAILURES.items() for x in kv]), error)


def failure_kind(expected: Column, actual: Column, truncated: Column) -> Column:
    """Nothing expected, then an exact match, then truncation, then a mismatch."""
    return F.when(is_blank(expected), "empty_ground_truth").when(expected == actual, "none").when(truncated, "truncated_no_eos").otherwise("model_mismatch")


def is_pipeline_failure(kind: Column) -> Column:
    return kind.isin(*PIPELINE_FAILURES)


def is_model_failure(kind: Column) -> Column:
    return kind.isin(*MODEL_FAILURES)


# --- repair of text, in this order: terminal codes, C1, ligatures, widths, quotes, line breaks, NFC, controls

#: Letters that stand for several.
LIGATURES = {
    "\u0132": "IJ", "\u0133": "ij", "\u0149": "\u02bcn",
    "\u01c4": "D\u017d", "\u01c5": "D\u017e", "\u01c6": "d\u017e", "\u01c7": "LJ", "\u01c8": "Lj", "\u01c9": "lj", "\u01ca": "NJ", "\u01cb": "Nj", "\u01cc": "nj",
    "\u01f1": "DZ", "\u01f2": "Dz", "\u01f3": "dz",
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "\u017ft", "\ufb06": "st",
}
#: Curly quotes, and control characters that go.
SINGLE_QUOTES, DOUBLE_QUOTES = "\u02bc\u2018\u2019\u201a\u201b", "\u201c\u201d\u201e\u201f"
CONTROLS = r"[\x00-\x08\x0B\x0E-\x1F\x7F\u206A-\u206F\uFEFF\uFFF9-\uFFFC]"


def c1_pairs() -> dict[str, str]:
    """U+0080 to U+009F as the same byte of Windows-1252, where that has a character."""
    out = {}
    for b in range(0x80, 0xA0):
        try:
            out[chr(b)] = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            continue
    return out


def width_pairs() -> dict[str, str]:
    """Full- and half-width forms and the wide space, as their compatibility forms."""
    return {chr(c): n for c in (0x3000, *range(0xFF01, 0xFFF0)) if (n := unicodedata.normalize("NFKC", chr(c))) != chr(c)}


def replaced(text: Column, pairs: dict[str, str]) -> Column:
    """Each character by its string: single characters in one pass, the others one after the other."""
    single = {k: v for k, v in pairs.items() if len(v) == 1}
    if single:
        text = F.translate(text, "".join(single), "".join(single.values()))
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), ((k, v) for k, v in pairs.items() if len(v) != 1), text)


@F.udf(T.StringType(), useArrow=True)
def nfc(text: str) -> str:
    """Canonical composition; there is no column expression for it."""
    return None if text is None else unicodedata.normalize("NFC", text)


def remove_terminal_codes(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[a-zA-Z]", "")


def uncurl_quotes(text: Column) -> Column:
    return F.translate(text, SINGLE_QUOTES + DOUBLE_QUOTES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))


def line_breaks(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n|[\r\u2028\u2029\u0085]", "\n")


def fix_text_before_nfc(text: Column) -> Column:
    """One chain of built-in replacements: all of it is compiled, which costs less than looking first whether a step has anything to do."""
    text = replaced(replaced(remove_terminal_codes(text), c1_pairs()), LIGATURES)
    return line_breaks(uncurl_quotes(replaced(text, width_pairs())))


def fix_text(text: Column, compose: bool = True) -> Column:
    """The repair steps that are deterministic. compose=False leaves NFC out, for texts known to be composed: then no Python runs."""
    text = fix_text_before_nfc(text)
    return F.regexp_replace(nfc(text) if compose else text, CONTROLS, "")


# --- LaTeX

#: Commands that renderers lack, environments that must be closed, names that \\up is a part of.
UNSUPPORTED = ("lefteqn", "boldmath", "ensuremath", "centering", "textsubscript", "sides", "textsl", "textcent", "emph", "protect", "null")
ENVIRONMENTS = ("array", "matrix", "pmatrix", "bmatrix", "vmatrix", "Bmatrix", "Vmatrix", "cases", "aligned", "gathered", "align", "align*")
KEPT_UP = ("arrow", "downarrow", "lus", "silon")


def unwrap_cjk_text(latex: Column) -> Column:
    """\\text{...} around Chinese is removed; so are double quotes."""
    return F.replace(F.regexp_replace(latex, r"\\text\s*\{\s*([^}]*?[\u4e00-\u9fff]+[^}]*?)\s*\}", "$1"), F.lit('"'), F.lit(""))


def count_command(latex: Column, name: str) -> Column:
    return F.regexp_count(latex, F.lit(rf"\\{name}(?![a-zA-Z])"))


def strip_left_right(latex: Column) -> Column:
    return F.regexp_replace(latex, r"\\left\.?|\\right\.?", "")


def occurrences(text: Column, part: str) -> Column:
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def balance_environment(latex: Column, name: str) -> Column:
    """Adds what is missing of \\begin and \\end: begins before (with the format of the first, or {c} for arrays), ends behind."""
    begin, end = f"\\begin{{{name}}}", f"\\end{{{name}}}"
    n_begin, n_end = occurrences(latex, begin), occurrences(latex, end)
    quoted = name.replace("*", r"\*")
    has = F.contains(latex, F.lit(begin + "{"))
    form = F.when(has, F.regexp_extract(latex, rf"\\begin\{{{quoted}\}}(\{{[^}}]*\}})", 1)).otherwise("{c}" if name == "array" else "")
    before = F.repeat(F.concat(F.lit(begin), form, F.lit(" ")), F.greatest(n_end - n_begin, F.lit(0)))
    behind = F.repeat(F.lit(" " + end), F.greatest(n_begin - n_end, F.lit(0)))
    return F.concat(before, latex, behind)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once: a lambda variable stands for it, so that a chain of uses doesn't multiply its tree."""
    return F.element_at(F.transform(F.array(value), use), 1)


def balance_environments(latex: Column) -> Column:
    some = lambda x, name: F.contains(x, F.lit(f"\\begin{{{name}}}")) | F.contains(x, F.lit(f"\\end{{{name}}}"))
    return reduce(lambda whole, name: bound(whole, lambda x: F.when(some(x, name), balance_environment(x, name)).otherwise(x)), ENVIRONMENTS, latex)


def remove_up(latex: Column) -> Column:
    """\\upX becomes \\X, but for arrows, \\uplus and \\upsilon."""
    kept = "|".join(KEPT_UP)
    return F.regexp_replace(latex, rf"\\up(?!(?:{kept})(?![a-zA-Z]))([a-zA-Z]+)", r"\\$1")


def remove_unsupported(latex: Column) -> Column:
    return F.regexp_replace(latex, r"\\(?:" + "|".join(UNSUPPORTED) + ")", "")


_MARKS = re.compile(r"[{}]|\\(?=left.|right.)", re.DOTALL)


def _escaped(text: str, at: int) -> bool:
    """Do an odd number of backslashes stand before the place?"""
    n = 0
    while at - n > 0 and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def _group_ends(text: str) -> dict[int, int]:
    """Where the group that holds each \\left and \\right ends, in one pass; those of no group that ends are left out."""
    groups, ends, holds, fresh = [0], {}, {}, 1
    for m in _MARKS.finditer(text):
        i = m.start()
        if m[0] == "\\":
            holds[i] = groups[-1]
        elif not _escaped(text, i):
            if m[0] == "}":
                ends[groups.pop()] = i
            if m[0] == "{" or not groups:  # a brace too many ends what is outside of all groups, and something new begins
                groups.append(fresh)
                fresh += 1
    return {i: ends[g] for i, g in holds.items() if g in ends}


def _pair_right_commands(text: str) -> str:
    """Where \\left and its \\right lie at different brace depths, \\right and its delimiter move to the end of \\left's group."""
    depth, opened, moves, at, ends = 0, [], [], 0, None
    while m := _MARKS.search(text, at):
        i = m.start()
        at = i + 1
        if _escaped(text, i):
            continue
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
        elif text.startswith("left", i + 1):
            opened.append((i, depth))
            at = i + 6
        else:
            at = i + 7
            if opened:
                start, level = opened.pop()
                if level and level != depth:  # what lies in no group has no end of a group to move to
                    ends = _group_ends(text) if ends is None else ends
                    if start in ends:
                        moves.append((i, ends[start]))
    for i, target in sorted(moves, reverse=True):
        if i + 7 <= len(text):
            part, rest = text[i : i + 7], text[:i] + text[i + 7 :]
            text = rest[:target] + part + rest[target:]
    return text


pair_right_commands = F.udf(lambda s: None if s is None else _pair_right_commands(s), T.StringType(), useArrow=True)


def balance_left_right(latex: Column) -> Column:
    return F.when(count_command(latex, "left") == count_command(latex, "right"), pair_right_commands(latex)).otherwise(strip_left_right(latex))


def repair_latex(latex: Column) -> Column:
    """The five LaTeX repairs, then fix_text."""
    return fix_text(remove_unsupported(remove_up(balance_environments(balance_left_right(unwrap_cjk_text(latex))))))


# --- escaping and blocks

def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def escape_attribute(text: Column) -> Column:
    text = escape_html(text)
    for char, entity in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


#: Fixed value: the mark of a formula without an end.
TRUNCATED = "<!-- formula truncated: no EOS token -->"


def display_math(latex: Column) -> Column:
    """Blank lines dropped, line ends trimmed, $$ escaped."""
    lines = F.filter(F.split(F.regexp_replace(latex, "\r\n?", "\n"), "\n"), lambda x: ~is_blank(x))
    joined = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")
    return F.replace(F.regexp_replace(joined, r"(?U)^\s+|\s+$", ""), F.lit("$$"), F.lit("\\$\\$"))


def markdown_block(latex: Column, truncated: Column) -> Column:
    body = display_math(latex)
    block = F.concat(F.lit("$$\n"), body, F.lit("\n$$"))
    return F.when(body == "", "").when(truncated, F.concat(block, F.lit("\n\n" + TRUNCATED))).otherwise(block)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x00-\x1F\x7F]+", " "))


# --- names, addresses, options

def language_tag(model: Column) -> Column:
    """What stands before the first marker of a model's name; null if nothing does."""
    return F.nullif(F.regexp_extract(model, r"^(.+?)(?:_PP|_ppocr)", 1), F.lit(""))


def model_variant(model: Column) -> Column:
    return F.when(F.regexp_like(F.lower(model), F.lit(r"_server[_.]")), "server").otherwise("mobile")


def file_name_of(url: Column) -> Column:
    return F.nullif(F.element_at(F.split(F.parse_url(url, F.lit("PATH")), "/"), -1), F.lit(""))


def query_parameter(url: Column, name: str) -> Column:
    return F.parse_url(url, F.lit("QUERY"), F.lit(name))


def parse_shard(raw: Column) -> Column:
    """INDEX/COUNT as struct<index,count>; null if it isn't one, or the index is not below the count."""
    index, count = F.try_element_at(F.split(raw, "/"), F.lit(1)).try_cast("int"), F.try_element_at(F.split(raw, "/"), F.lit(2)).try_cast("int")
    good = F.regexp_like(raw, F.lit(r"^[0-9]+/[0-9]+\z")) & (count > 0) & (index < count)
    return F.when(good, F.struct(index.alias("index"), count.alias("count")))


def parse_split(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(low.isin("train", "test", "validate"), low).when(low.isin("val", "validation"), "validate")


def is_model_file_name(name: Column) -> Column:
    """A bare file name: no folder, drive, control character or dot alone."""
    return F.regexp_like(name, F.lit(r"^(?!\.{1,2}\z)[^/\\:\x00-\x1F]+\z"))


def is_sha256(value: Column) -> Column:
    return F.regexp_like(value, F.lit(r"^[0-9a-fA-F]{64}\z"))


def has_chinese(text: Column) -> Column:
    return F.regexp_like(text, F.lit("[\u4e00-\u9fff\u3000-\u303f\uff00-\uffef]"))


def source_image_name(path: Column) -> Column:
    """The name beside a report under which a page's image is kept: <stem>-source.<extension>; source and png where the path has none."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    stem = F.coalesce(F.nullif(F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1), F.lit("")), F.nullif(name, F.lit("")), F.lit("source"))
    kind = F.when(F.regexp_like(name, F.lit(r"(?s)^.+\.[^.]*$")), F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise("png")
    return F.concat(stem, F.lit("-source."), kind)


def formula_html(latex: Column, truncated: Column, eos_index: Column) -> Column:
    """A formula as a block of HTML that carries its LaTeX."""
    flag, end = F.when(truncated, "true").otherwise("false"), F.coalesce(eos_index.cast("string"), F.lit("none"))
    return F.concat(
        F.lit('<div class="formula" data-latex="'), escape_attribute(latex), F.lit('" data-truncated="'), flag, F.lit('" data-eos="'), end,
        F.lit('"><span class="formula-latex">'), escape_html(latex), F.lit("</span></div>"),
    )


def download_refusal(url: Column, hosts: tuple[str, ...]) -> Column:
    """Why a file may not be fetched from an address: scheme (https alone will do) or host (named, in full); null if it may."""
    return F.when(~F.coalesce(F.parse_url(url, F.lit("PROTOCOL")) == "https", F.lit(False)), "scheme").when(~F.coalesce(F.parse_url(url, F.lit("HOST")).isin(*hosts), F.lit(False)), "host")


def first_change(text: Column, steps: dict[str, Column]) -> Column:
    """The name of the first step whose result is not the text; null if all leave it as it is."""
    return F.coalesce(*[F.when(~out.eqNullSafe(text), F.lit(name)) for name, out in steps.items()])
