import pytest
from pyspark.sql import functions as F

from loomgraph.functions import constants as K
from loomgraph.functions import text as X

Z = K.ZWNJ


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit(s):
    return F.lit(s)


CASES = [
    (lambda: X.normalize(lit("مسئول مسائل مؤثر")), "مسیول مسایل موثر"),
    (lambda: X.normalize(lit("مسئول مسائل مؤثر"), hamza=False), "مسئول مسائل مؤثر"),
    (lambda: X.normalize(lit("کافۀ شهر")), f"کافه{Z}ی شهر"),
    (lambda: X.normalize(lit("کافۀ شهر"), ezafe_mode="collapse"), "کافه شهر"),
    (lambda: X.normalize(lit("كلاس ۱۲۳ـَ")), "کلاس 123"),
    (lambda: X.normalize(lit(f"کتاب {Z} ها"), half_space_mode="preserve"), f"کتاب{Z}ها"),
    (lambda: X.normalize(lit(f"کتاب{Z}ها"), half_space_mode="split"), "کتاب ها"),
    (lambda: X.normalize(lit(f"کتاب{Z}ها"), half_space_mode="remove"), "کتابها"),
    (lambda: X.sentences(lit("سلام دنیا! چه خبر؟ خوبه.")), ["سلام دنیا", "چه خبر", "خوبه"]),
    (lambda: X.summary_sentences(lit("جمله اول. جمله دوم! جمله سوم؟")), ["جمله اول", "جمله دوم", "جمله سوم"]),
    (lambda: X.article_sentences(lit("یک. دو! سه؟ چهار")), ["یک.", "دو!", "سه؟", "چهار"]),
    (lambda: X.join_compound_verbs(lit("تصمیم گرفت")), f"تصمیم{Z}گرفت"),
    (lambda: X.split_morphology(lit(f"نمی{Z}روم")), ["نمی", "روم"]),
    (lambda: X.split_morphology(lit(f"کتاب{Z}ها")), ["کتاب", "##ها"]),
    (lambda: X.char_chunks(lit("abcdefgh")), ["abc", "##def", "##gh"]),
    (lambda: X.char_chunks(lit("abcd")), ["abcd"]),
    (lambda: X.surface_stem(lit(f"کتاب{Z}هایمان")), "کتاب"),
    (lambda: X.concept_root(lit("«کتاب‌ها»،")), "«کتاب‌ها»"),
    (lambda: X.concept_root(lit("زندگی.")), "زندگی"),
    (lambda: X.char_ngrams(lit("ababa"), 3), ["aba", "bab"]),
    (lambda: X.char_ngrams(lit("ab"), 3), ["ab"]),
    (lambda: X.char_ngrams(lit(""), 3), []),
    (lambda: X.script_ratio(lit("متن فارسی")), 1.0),
    (lambda: X.script_ratio(lit("123")), 0.0),
    (lambda: X.tokenize(lit("Ab_1 2x é")), ["Ab_1", "2", "x", "é"]),
    (lambda: X.keywords(lit("یک، دو;سه| ")), ["یک", "دو", "سه"]),
    (lambda: X.chunks(F.array(*map(F.lit, range(5))), 3), [[0, 1], [2, 3], [4]]),
    (lambda: X.chunks(F.array(F.lit(1)), 3), [[1], [], []]),
    (lambda: X.contains_any(lit("abc"), ["x", "b"]), True),
    (lambda: X.contains_any(lit("abc"), []), False),
    (lambda: X.hate_label(lit(" Toxic ")), "hate"),
    (lambda: X.hate_label(lit("no")), "no"),
    (lambda: X.hate_label(lit(" Safe\n")), "normal"),
    (lambda: X.hate_label(lit("نفرت")), "hate"),
    (lambda: X.hate_label(lit("عادی")), "normal"),
    (lambda: X.hate_label(lit("Spam")), "spam"),
    (lambda: X.normalize(lit("خانة\u0654 ما")), "خانه\u200cی ما"),
    (lambda: X.normalize(lit("خانهٔ ما"), ezafe_mode="collapse"), "خانه ما"),
    (lambda: X.normalize(lit("كتـابٌ"), tatweel=False), "کتـاب"),
    (lambda: X.clean_wiki(lit("می\u200cرود\x07 علي  ")), "می رود علی"),
    (lambda: X.focus_terms(lit("رابطه میان گل و بلبل، خار چیست؟")), ["گل", "بلبل", "خار"]),
    (lambda: X.response_plan(lit("خلاصه و مقایسه")), ["summary", "comparison"]),
    (lambda: X.response_plan(lit("سلام")), ["structure"]),
    (lambda: X.byte_tokens(lit("é")), ["<0xC3>", "<0xA9>"]),
    (lambda: X.join_byte_tokens(F.array(lit("a"), lit("<0xC3>"), lit("<0xA9>"), lit("b"), lit("<0xFF>"))), ["a", "é", "b", "\ufffd"]),
    (lambda: X.augment_text(lit("الف، ب! ج؟ د"), lit(1), 1.0, 0.0), "الف ب ج د"),
    (lambda: X.entities(lit("شرکت ملی نفت. دانشگاه تهران. شرکت ملی نفت")), ["شرکت ملی نفت", "دانشگاه تهران"]),
    (lambda: X.is_meaningful(lit("کتاب")), True),
    (lambda: X.is_meaningful(lit("از")), False),
    (lambda: X.is_meaningful(lit("doc_3")), False),
    (lambda: X.is_meaningful(lit("<unk>")), False),
    (lambda: X.is_meaningful(lit("12")), False),
    (lambda: X.is_meaningful(lit("کتاب"), lit("Topic")), False),
    (lambda: X.looks_like_poetry(lit("a\nb")), True),
    (lambda: X.looks_like_poetry(lit("a" * 200 + "\nb")), False),
    (lambda: X.normalise_answer(lit("  The  Answer_is: 42! ")), "the answer is 42"),
    (lambda: X.decode_tokens(F.array(*map(F.lit, ["سلام", "،", "دنیا", "؟", "(", "خوب", ")", "است", "."]))), "سلام، دنیا؟ (خوب) است."),
    (lambda: X.decode_tokens(F.array(*map(F.lit, ["abc", "##def", "x"]))), "abcdef x"),
    (lambda: X.prompt_completion(lit("p"), lit("c")), "دستور:\np\n\nپاسخ:\nc"),
    (lambda: X.simhash_similarity(lit(0), lit(-1)), 0.0),
    (lambda: X.simhash(F.array().cast("array<string>")), -1),
    (lambda: X.unicode_form(lit("é")), "é"),
    (lambda: X.collapse_space(lit(" a\x1c  b\n")), "a b"),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_case(spark, number):
    column, want = CASES[number]
    assert value(spark, column()) == want


def test_lm_tokens(spark):
    got = value(spark, X.lm_tokens(X.normalize(F.lit("قیمت ۱۲٫۵ دلار شد و ۱٬۰۰۰ تومان است."))))
    assert "12.5" in got and "1,000" in got and got[-1] == "."


def test_space_class_is_pythons(spark):
    rows = spark.createDataFrame([(i, f"a{chr(i)}b") for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000], "c int, t string")
    got = {r.c for r in rows.filter(F.col("t").rlike(f"a{K.SPACE}b")).collect()}
    assert got == {i for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000 and len(f"a{chr(i)}b".split()) == 2}


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    for f in (X.normalize, X.tokenize, X.sentences, X.char_chunks, X.surface_stem, X.text_hash, X.script_ratio, X.duplicate_key):
        df.select(f("t")).collect()


def test_collapsed_and_ratio_equal_plain_python(spark):
    spaces = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"
    texts = ["", " ", "a b", "  a  b ", " a\n", "a 　b\t c", "\x85\xa0x\x1f y", *(f"{x}a{x}{y}b {x}c{y}" for x in spaces for y in spaces), "ΟΔΟΣ   ΣΑ İ"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, t string")
    got = {r.i: r for r in rows.select("i", X.collapse_space("t").alias("c"), X.text_hash("t").alias("h"), X.collapsed_hash(X.collapse_space("t")).alias("k"), X.script_ratio("t", "A-Za-z").alias("r")).collect()}
    for i, x in enumerate(texts):
        assert got[i].c == " ".join(x.split()) and got[i].h == got[i].k
        letters = [c for c in x if c.isalpha()]
        assert got[i].r == (sum(c.isascii() for c in letters) / len(letters) if letters else 0.0)
    assert got[len(texts)].c is None and got[len(texts)].r is None


def test_gate_of_letters_makes_no_array_of_characters(spark):
    """A count of matches is an array of all characters of a text; `build_corpus` without near duplicates makes no simhash."""
    from loomgraph.operators import corpus

    row = spark.createDataFrame([(1, "some text of words")], "doc_id int, text string")
    assert "regexp_extract_all" not in row.select(X.script_ratio("text"))._jdf.queryExecution().optimizedPlan().toString()
    seen, X_simhash = [], X.simhash
    X.simhash = lambda t: (seen.append(1), X_simhash(t))[1]
    try:
        corpus.build_corpus(row, near_threshold=None).collect()
    finally:
        X.simhash = X_simhash
    assert not seen


def test_stems_are_made_once_a_word(spark):
    """The filter on stems would go below a distinct of words otherwise, and stem every occurrence."""
    from loomgraph.operators import graphs

    words = spark.createDataFrame([("کتاب کتابها کتاب x",)], "t string").select(F.explode(F.split("t", " ")).alias("token")).distinct()
    for make in (graphs.stem_edges, graphs.subword_edges):
        assert "Generate" not in make(words)._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.src, r.dst) for r in graphs.stem_edges(words).collect()] == [("کتاب", "کتابها")]
