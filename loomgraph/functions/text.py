"""Scalar text functions as Spark columns. Null in, null out unless a docstring says otherwise."""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _alternatives(words: tuple[str, ...]) -> str:
    """A pattern of literal words, the longest first."""
    return "|".join(rf"\Q{w}\E" for w in sorted(words, key=len, reverse=True))


# normalisation


def unicode_form(column: str | Column, form: str = "NFC") -> Column:
    """Unicode normalisation. ASCII rows stay in the JVM; the others cross to Python in Arrow batches."""

    @F.pandas_udf("string")
    def normalised(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    c = _c(column)
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(normalised(F.when(F.length(c) != F.octet_length(c), c)))


def unify_letters(column: str | Column) -> Column:
    return F.translate(_c(column), K.ARABIC_LETTERS, K.PERSIAN_LETTERS)


def fold_hamza(column: str | Column) -> Column:
    return F.translate(_c(column), K.HAMZA_LETTERS, K.PLAIN_LETTERS)


def ezafe(column: str | Column, mode: str = "marker") -> Column:
    """The ezafe written over heh: as a half-space and ye (`marker`) or dropped (`collapse`)."""
    to = {"marker": "ه" + K.ZWNJ + "ی", "collapse": "ه"}[mode]
    return F.replace(F.replace(_c(column), F.lit("ۀ"), F.lit(to)), F.lit("هٔ"), F.lit(to))


def ascii_digits(column: str | Column) -> Column:
    return F.translate(_c(column), K.DIGITS_FROM + K.SEPARATORS_FROM, K.DIGITS_TO + K.SEPARATORS_TO)


def drop_marks(column: str | Column, tatweel: bool = True, diacritics: bool = True) -> Column:
    """Without tatweel, diacritics and zero-width characters other than the half-space; the last always go."""
    return F.translate(_c(column), (K.TATWEEL if tatweel else "") + (K.DIACRITICS if diacritics else "") + K.ZERO_WIDTH, "")


def half_space(column: str | Column, mode: str = "preserve") -> Column:
    c = _c(column)
    if mode == "split":
        return F.translate(c, K.ZWNJ, " ")
    if mode == "remove":
        return F.translate(c, K.ZWNJ, "")
    if mode == "preserve":
        return F.regexp_replace(c, f"{K.SPACE}*{K.ZWNJ}{K.SPACE}*", K.ZWNJ)
    raise ValueError("half-space mode must be preserve, split or remove")


#: Runs of white space that are not one blank, so that the blanks between words are left alone; two ranges before the list, so that most letters fail at once.
_RUNS = rf" {K.SPACE}+|[\x00-\x1f\x{{85}}-\x{{3000}}&&{K.SPACE}]{K.SPACE}*"


def collapse_space(column: str | Column) -> Column:
    return F.trim(F.regexp_replace(_c(column), _RUNS, " "))


def normalize(
    column: str | Column,
    form: str | None = "NFC",
    hamza: bool = True,
    ezafe_mode: str | None = "marker",
    digits: bool = True,
    tatweel: bool = True,
    diacritics: bool = True,
    half_space_mode: str = "preserve",
) -> Column:
    """The configurable normaliser: Unicode form, letters, hamza, ezafe, digits, marks, half-space, white space, in this order."""
    c = _c(column)
    if form:
        c = unicode_form(c, form)
    c = unify_letters(c)
    if hamza:
        c = fold_hamza(c)
    if ezafe_mode:  # after the letters, which give heh, and before the marks, which hold its hamza
        c = ezafe(c, ezafe_mode)
    if digits:
        c = ascii_digits(c)
    return collapse_space(half_space(drop_marks(c, tatweel, diacritics), half_space_mode))


def preprocess(column: str | Column) -> Column:
    """The plain pipeline: ye and kaf, half-space to space, no diacritics, single spaces."""
    c = half_space(F.translate(_c(column), "يك", "یک"), "split")
    return collapse_space(F.translate(c, K.DIACRITICS, ""))


# tokens and sentences


def tokenize(column: str | Column) -> Column:
    return F.regexp_extract_all(_c(column), F.lit(K.WORD), F.lit(0))


def tokenize_persian(column: str | Column) -> Column:
    return F.regexp_extract_all(normalize(column, half_space_mode="split"), F.lit(K.WORD_RUN), F.lit(0))


def lm_tokens(column: str | Column) -> Column:
    return F.regexp_extract_all(_c(column), F.lit(K.LM_TOKEN), F.lit(0))


def _kept(parts: Column) -> Column:
    strip = lambda x: F.regexp_replace(x, f"^{K.SPACE}+|{K.SPACE}+$", "")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def sentences(column: str | Column) -> Column:
    return _kept(F.regexp_extract_all(_c(column), F.lit(K.SENTENCE_RUNS), F.lit(0)))


def summary_sentences(column: str | Column) -> Column:
    return _kept(F.split(_c(column), K.SUMMARY_END))


def graph_sentences(column: str | Column) -> Column:
    return _kept(F.split(_c(column), K.GRAPH_END))


def article_sentences(column: str | Column) -> Column:
    return _kept(F.split(_c(column), f"(?<=[.؟!]){K.SPACE}+"))


def join_compound_verbs(column: str | Column) -> Column:
    return F.regexp_replace(_c(column), f"([{K.ARABIC_BLOCK}]+){K.SPACE}+({_alternatives(K.COMPOUND_LIGHT_VERBS)})(?={K.SPACE}|$)", f"$1{K.ZWNJ}$2")


def _without_end(word: Column, suffixes: tuple[str, ...], spare: int, skip: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(word without its first fitting suffix, that suffix or empty); the rest must be longer than `spare` characters."""
    stem, found = word, F.lit("")
    for s in reversed(suffixes):
        fits = word.endswith(s) & (F.length(word) > len(s) + spare)
        if skip and s in skip:
            fits = fits & ~word.endswith(skip[s])
        stem = F.when(fits, F.regexp_replace(F.substring(word, F.lit(1), F.length(word) - len(s)), K.ZWNJ + "+$", "")).otherwise(stem)
        found = F.when(fits, F.lit(s)).otherwise(found)
    return stem, found


def split_morphology(column: str | Column) -> Column:
    """At most one prefix, the stem, and at most one suffix marked by ##."""
    word = _c(column)
    prefix, rest = F.lit(""), word
    for p in reversed(K.PREFIXES):
        fits = word.startswith(p) & (F.length(word) > len(p) + 1)
        prefix = F.when(fits, F.lit(p.rstrip(K.ZWNJ))).otherwise(prefix)
        rest = F.when(fits, F.substring(word, F.lit(len(p) + 1), F.length(word))).otherwise(rest)
    stem, suffix = _without_end(rest, K.SUFFIXES, 1)
    parts = F.array_remove(F.array(prefix, stem, F.when(suffix == "", F.lit("")).otherwise(F.concat(F.lit("##"), suffix))), "")
    return F.when(F.size(parts) == 0, F.array(word)).otherwise(parts)


def char_chunks(column: str | Column, size: int = 3) -> Column:
    """Pieces of `size` characters, later ones marked by ##; words of at most size + 1 stay whole."""
    word = _c(column)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)), F.lit(size)), lambda i: F.concat(F.when(i > 1, F.lit("##")).otherwise(F.lit("")), F.substring(word, i, F.lit(size))))
    return F.when(F.length(word) <= size + 1, F.array(word)).otherwise(cut)


def surface_stem(column: str | Column) -> Column:
    word = F.regexp_replace(F.replace(_c(column), F.lit("##"), F.lit("")), f"^{K.ZWNJ}+|{K.ZWNJ}+$", "")
    return _without_end(word, K.SUFFIXES, 1)[0]


def strip_label(column: str | Column) -> Column:
    edge = "[" + "".join("\\" + c if c in "[]" else c for c in K.LABEL_PUNCTUATION) + "]+"
    trimmed = F.regexp_replace(_c(column), f"^{K.SPACE}+|{K.SPACE}+$", "")
    return F.regexp_replace(trimmed, f"^{edge}|{edge}$", "")


def concept_root(column: str | Column) -> Column:
    word = strip_label(column)
    stem, found = _without_end(word, K.ROOT_SUFFIXES, 2, skip={"ی": "گی"})
    return F.when(found == "", F.regexp_replace(word, K.ZWNJ + "+$", "")).otherwise(stem)


def char_ngrams(column: str | Column, n: int = 3) -> Column:
    """The set of character n-grams; a shorter text is its own, an empty one has none."""
    c = _c(column)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(grams)


def token_ngrams(column: str | Column, n: int = 3) -> Column:
    return char_ngrams(F.replace(_c(column), F.lit("##"), F.lit("")), n)


# keys, ratios, answers


def hash_key(column: str | Column) -> Column:
    return _key_of(collapse_space(column))


def _key_of(collapsed: Column) -> Column:
    return F.translate(F.lower(collapsed), "يك", "یک")


def text_hash(column: str | Column) -> Column:
    return F.sha2(hash_key(column), 256)


def collapsed_hash(collapsed: str | Column) -> Column:
    """`text_hash` of a text whose white space is collapsed already."""
    return F.sha2(_key_of(_c(collapsed)), 256)


def duplicate_key(column: str | Column) -> Column:
    return F.regexp_replace(F.lower(collapse_space(column)), rf"[^\p{{L}}\p{{N}}_{K.ARABIC_BLOCK}{K.ZWNJ}]+", "")


def script_ratio(column: str | Column, script: str = K.ARABIC_BLOCK) -> Column:
    """Characters of the script among letters and characters of the script; 0 without any. `script`: the inside of a character class."""
    # by lengths of what is left: a count of matches would make an array of all characters
    letters = F.regexp_replace(_c(column), rf"[^\p{{L}}{script}]+", "")
    ratio = lambda x: F.when(F.length(x) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(x, f"[^{script}]+", "")) / F.length(x))
    # in a lambda, so that the letters are taken once
    return F.get(F.transform(F.array(letters), ratio), F.lit(0))


def normalise_answer(column: str | Column) -> Column:
    c = F.regexp_replace(collapse_space(F.lower(_c(column))), r"[^\p{L}\p{N}]+", " ")
    return F.trim(c)


def simhash(tokens: str | Column) -> Column:
    """64-bit simhash of an array of tokens, as a long; all ones without tokens. Token hashes are xxhash64."""
    @F.arrow_udf("long")
    def voted(column: pa.Array) -> pa.Array:
        """Counts of each byte's values in a row, from which the bits' counts follow."""
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, octets = np.concatenate([[0], np.cumsum(n)]), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
        bit_of = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)
        out = np.zeros((len(n), 8), np.uint8)
        for a in range(0, len(n), 1024):
            b = min(len(n), a + 1024)
            row = np.repeat(np.arange(b - a), n[a:b]) * 256
            for k in range(8):
                ones = np.bincount(row + octets[ends[a] : ends[b], k], minlength=(b - a) * 256).reshape(-1, 256) @ bit_of
                out[a:b, k] = np.packbits(2 * ones >= n[a:b, None], axis=1, bitorder="little")[:, 0]
        return pa.array(out.reshape(-1).view(np.int64), pa.int64())

    t = _c(tokens)
    return F.when(t.isNotNull(), voted(F.coalesce(F.transform(t, lambda x: F.xxhash64(x)), F.array().cast("array<bigint>")))).otherwise(F.lit(0).cast("long"))


def simhash_similarity(a: str | Column, b: str | Column) -> Column:
    return 1 - F.bit_count(_c(a).bitwiseXOR(_c(b))) / 64.0


# lists, labels, texts


def keywords(column: str | Column) -> Column:
    return _kept(F.split(_c(column), r"[,،;؛|]"))


def metadata(column: str | Column) -> Column:
    return F.coalesce(F.from_json(_c(column), "map<string,string>"), F.create_map().cast("map<string,string>"))


def chunks(array: str | Column, count: int) -> Column:
    """An array in exactly `count` contiguous chunks, the last ones empty if need be."""
    a = _c(array)
    size = F.greatest(F.ceil(F.size(a) / count), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice(a, i * size + 1, size))


def contains_any(column: str | Column, terms: list[str]) -> Column:
    """Whether the text has one of the terms in it."""
    return reduce(lambda a, b: a | b, (F.contains(_c(column), F.lit(t)) for t in terms), F.lit(False))


def hate_label(column: str | Column) -> Column:
    """hate or normal for the labels that stand for them; any other comes back in lower case."""
    c = F.lower(F.regexp_replace(_c(column).cast("string"), f"^{K.SPACE}+|{K.SPACE}+$", ""))
    return F.when(c.isin(*K.HATE_LABELS), "hate").when(c.isin(*K.NORMAL_LABELS), "normal").otherwise(c)


def entities(column: str | Column, limit: int = 12) -> Column:
    """Names that a title noun opens, with up to three words after it: distinct, in order."""
    word = f"[{K.ARABIC_BLOCK}{K.ZWNJ}]+"
    pattern = f"(?:{'|'.join(K.NAME_NOUNS)}){K.SPACE}+{word}(?:{K.SPACE}+{word}){{0,2}}"
    return F.slice(F.array_distinct(F.regexp_extract_all(_c(column), F.lit(pattern), F.lit(0))), 1, limit)


def is_meaningful(label: str | Column, node_type: str | Column | None = None) -> Column:
    """Whether a node label stands for a concept."""
    c = strip_label(label)
    ok = ~c.isin(*K.STOP_WORDS) & ~c.startswith("doc_") & ~c.startswith("document:") & ~(c.startswith("<") & c.endswith(">")) & ~c.startswith("##")
    ok = ok & ~c.rlike(r"^\p{Nd}+$") & (F.length(c) >= 2)
    return ok if node_type is None else ok & ~F.coalesce(F.lower(_c(node_type)).isin(*K.NODE_TYPES_WITHOUT_CONCEPT), F.lit(False))


def looks_like_poetry(column: str | Column, median: int = 60, longest: int = 110) -> Column:
    lengths = F.array_sort(F.transform(_kept(F.split(_c(column), "\n")), lambda x: F.length(x)))
    n = F.size(lengths)
    return F.coalesce((n >= 2) & (F.get(lengths, F.floor(n / 2).cast("int")) <= median) & (F.get(lengths, n - 1) <= longest), F.lit(False))


def clean_wiki(column: str | Column) -> Column:
    letters = F.translate(half_space(column, "split"), "يك", "یک")
    return collapse_space(F.regexp_replace(letters, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "))


def term_hits(column: str | Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.contains(_c(column), F.lit(t)).cast("int") for t in terms), F.lit(0))


def drop_tokens(tokens: str | Column, key: str | Column, share: float, minimum: int = 1, seed: int = 0) -> Column:
    """Tokens without about `share` of them, chosen by a hash of seed, key and place; at least `minimum` stay, else all."""
    t = _c(tokens)
    kept = F.filter(t, lambda x, i: F.pmod(F.xxhash64(F.lit(seed), _c(key), i), F.lit(1_000_000)) >= int(share * 1_000_000))
    return F.when(F.size(kept) >= minimum, kept).otherwise(t)


def augment_text(column: str | Column, key: str | Column, punctuation: float = 0.5, share: float = 0.05, minimum: int = 3, seed: int = 0) -> Column:
    """A text without punctuation in about `punctuation` of all texts and without about `share` of its words; both chosen by hashes of seed, key and place."""
    c = _c(column)
    drawn = F.pmod(F.xxhash64(F.lit(seed), _c(key), F.lit("punctuation")), F.lit(1_000_000)) < int(punctuation * 1_000_000)
    words = F.filter(F.split(F.when(drawn, F.regexp_replace(c, K.AUGMENT_PUNCTUATION, " ")).otherwise(c), K.SPACE + "+"), lambda w: w != "")
    kept = F.when(F.size(words) > minimum, drop_tokens(words, key, share, minimum, seed)).otherwise(words)
    return F.array_join(kept, " ")


def byte_tokens(token: str | Column) -> Column:
    """The names of the byte tokens that spell a token in UTF-8."""
    digits = F.hex(F.encode(_c(token), "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda i: F.concat(F.lit("<0x"), F.substring(digits, i, F.lit(2)), F.lit(">")))


def join_byte_tokens(tokens: str | Column) -> Column:
    """Tokens with runs of byte tokens as one token each, the text that the bytes spell; what is no UTF-8 becomes U+FFFD."""

    @F.pandas_udf("array<string>")
    def joined(column: pd.Series) -> pd.Series:
        def one(found) -> list[str]:
            out, held = [], bytearray()
            for t in found:
                if len(t) == 6 and t.startswith("<0x") and t.endswith(">") and all(c in "0123456789abcdefABCDEF" for c in t[3:5]):
                    held.append(int(t[3:5], 16))
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held = bytearray()
                out.append(t)
            return out + [held.decode("utf-8", "replace")] if held else out

        return column.map(lambda x: None if x is None else one(x))

    t = _c(tokens)
    # rows without byte tokens stay in the JVM
    some = F.exists(t, lambda x: x.startswith("<0x"))
    return F.when(some, joined(F.when(some, t))).otherwise(t)


def focus_terms(task: str | Column, limit: int = 12) -> Column:
    """Concept roots that a task asks about: the parts of `relation between ...` if it says so, else its words; distinct, in order."""
    c = _c(task)
    between = F.regexp_extract(c, rf"(?s)رابطه{K.SPACE}+میان{K.SPACE}+(.+?)(?:چیست|است|هست|[؟?]|$)", 1)
    parts = F.when(between != "", _kept(F.split(between, rf"[،,\n]|{K.SPACE}+و{K.SPACE}+"))).otherwise(tokenize(c))
    roots = F.transform(parts, concept_root)
    return F.slice(F.array_distinct(F.filter(roots, is_meaningful)), 1, limit)


def response_plan(task: str | Column) -> Column:
    """The kinds of answer that the words of a task ask for: summary, concepts, relations, evidence, comparison; structure if none."""
    c = _c(task)
    asks = lambda *words: reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))
    found = F.array_compact(
        F.array(
            F.when(asks("خلاصه"), "summary"), F.when(asks("تحلیل", "مفهوم"), "concepts"), F.when(asks("رابطه"), "relations"),
            F.when(asks("شواهد", "توضیح", "چرا"), "evidence"), F.when(asks("مقایسه"), "comparison"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("structure"))).otherwise(found)


def decode_tokens(tokens: str | Column) -> Column:
    """Tokens as text: ## pieces joined, punctuation attached again."""
    text = F.regexp_replace(F.array_join(_c(tokens), " "), r" ##|^##", "")
    text = F.replace(text, F.lit(f" {K.ZWNJ} "), F.lit(K.ZWNJ))
    text = F.regexp_replace(text, rf"{K.SPACE}+([{K.CLOSING}])", "$1")
    return F.regexp_replace(text, rf"([{K.OPENING}]){K.SPACE}+", "$1")


def prompt_completion(prompt: str | Column, completion: str | Column) -> Column:
    return F.concat(F.lit("دستور:\n"), _c(prompt), F.lit("\n\nپاسخ:\n"), _c(completion))


def article_line(title: str | Column, body: str | Column, words: str | Column) -> Column:
    """An article as one line: title, key words, introduction (first sentence), body and conclusion (last sentence), joined by ` | `."""
    s = article_sentences(body)
    part = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(name + ": "), c))
    return F.concat_ws(
        " | ", part("عنوان", F.trim(_c(title))), part("کلیدواژه", F.array_join(_c(words), "، ")), part("مقدمه", F.get(s, F.lit(0))), part("متن", collapse_space(body)), part("نتیجه", F.get(s, F.size(s) - 1))
    )
