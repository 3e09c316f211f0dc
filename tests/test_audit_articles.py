import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import corpus

BODY = "مدل زبانی فارسی برای نوشتن مقاله باید ساختار عنوان، مقدمه و بخش‌ها را از داده‌های انسانی یاد بگیرد؟"
ARTICLES = [
    (1, "مدل فارسی", BODY, "s", ["k"], {"source": "unit"}),
    (2, "مدل فارسی تکراری", BODY, None, [], {"url": "u"}),
    (3, "", BODY[:-1] + " می روم نمی  دانم?", "", None, None),
    (4, "گراف مقاله", "گراف متن رابطه میان مفهوم‌ها را نگه می‌دارد و در زمان تولید مقاله کمک می‌کند 12 ab.", None, ["a", "b"], {"source": "unit", "x": "1"}),
    (5, "t", "short", None, [], {}),
    (6, None, None, None, [], {}),
    (7, "t", "   ", None, [], {}),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "number long, title string, body string, summary string, keywords array<string>, metadata map<string,string>")


def near(a, b, n=13):
    grams = []
    for t in (a, b):
        t = re.sub(r"[^\w؀-ۿ‌]+", "", re.sub(r"\s+", " ", t).strip().lower())
        grams.append({t[i : i + n] for i in range(max(1, len(t) - n + 1))})
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1])


def test_every_section(spark):
    rows = corpus.audit_articles(frame(spark, ARTICLES), min_body=20, tokenizers={"word": X.tokenize(F.col("line")), "lower": X.tokenize(F.lower("line"))}, validation=0.34).collect()
    got = {}
    for r in rows:
        assert (r.section, r.name) not in got
        got[r.section, r.name] = r.value
    section = lambda s: {n: v for (x, n), v in got.items() if x == s}
    kept = [a for a in ARTICLES if len(" ".join((a[2] or "").split())) >= 20]
    assert section("records") == {"accepted_records": 4, "rejected_records": 3, "missing_title_count": 1, "summary_present_count": 1, "keywords_present_count": 2}
    assert section("rejection_reasons") == {"body_too_short": 1, "missing_body": 2}
    lengths = [len(a[2]) for a in kept]
    assert section("body_chars") == {"min_chars": min(lengths), "max_chars": max(lengths), "mean_chars": pytest.approx(sum(lengths) / 4)}
    joined = "".join((a[1] or "") + a[2] for a in kept)
    chars = section("characters")
    assert chars["total"] == len(joined) and chars["zwnj"] == joined.count("‌") and chars["latin_letters"] == 2 and chars["script_letters"] == sum("؀" <= c <= "ۿ" for c in joined)
    bodies = [a[2] for a in kept]
    assert section("surface") == {
        "zwnj_count": sum(b.count("‌") for b in bodies),
        "space_after_mi_prefix_count": sum(len(re.findall(r"(?:^|\s)(?:می|نمی)\s+[؀-ۿ]+", b)) for b in bodies),
        "ascii_question_mark_count": sum(b.count("?") for b in bodies),
        "persian_question_mark_count": sum(b.count("؟") for b in bodies),
    }
    pairs = [(a, b) for i, a in enumerate(sorted(set(bodies))) for b in sorted(set(bodies))[i + 1 :] if near(a, b) >= 0.82]
    assert section("duplicates") == {"exact_duplicates": 1, "near_duplicate_pairs": len(pairs), "near_duplicate_articles": sum(any(b in p for p in pairs) for b in bodies)}
    assert section("metadata key") == {"source": 2, "url": 1, "x": 1} and section("metadata source") == {"unit": 2, "u": 1}
    for name in ("word", "lower"):
        train, held = section(f"tokenizer {name} train"), section(f"tokenizer {name} validation")
        assert train["examples"] == 3 and held["examples"] == 1 and train["unk_rate"] == 0 and train["vocab_size"] > 5 and 0 <= held["unk_rate"] <= 1


def test_without_articles_or_options(spark):
    got = {(r.section, r.name): r.value for r in corpus.audit_articles(frame(spark, ARTICLES[4:])).collect()}
    assert got["records", "rejected_records"] == 3 and got["duplicates", "near_duplicate_pairs"] == 0
    corpus.audit_articles(frame(spark, []), tokenizers={"word": X.tokenize(F.col("line"))}).collect()


def test_near_articles_in_numbers(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(6)]
    bodies = base + [b + " tail" for b in base[:3]] + [base[0]] * 4
    rows = [(k, "t", b, None, None, None) for k, b in enumerate(bodies)]
    got = {(r.section, r.name): r.value for r in corpus.audit_articles(frame(spark, rows)).collect()}
    assert got["duplicates", "exact_duplicates"] == 4 and got["duplicates", "near_duplicate_pairs"] == 3 and got["duplicates", "near_duplicate_articles"] == 10
