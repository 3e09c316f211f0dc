"""Character tables, word lists and patterns that results must equal."""

ZWNJ = "\u200c"

# Letters that are unified.
ARABIC_LETTERS, PERSIAN_LETTERS = "يىكة", "ییکه"
HAMZA_LETTERS, PLAIN_LETTERS = "ئؤ", "یو"
# Digits of both blocks, numeric separators.
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
SEPARATORS_FROM, SEPARATORS_TO = "٫٬", ".,"
# Characters that are dropped.
TATWEEL = "\u0640"
DIACRITICS = "\u064b\u064c\u064d\u064e\u064f\u0650\u0651\u0652\u0653\u0654\u0655\u0670"
ZERO_WIDTH = "\u200b\u200d\ufeff"

# Punctuation around labels.
LABEL_PUNCTUATION = "،.;:؟!()[]{}\"'"
# Light verbs that join the word before them.
COMPOUND_LIGHT_VERBS = ("کرد", "کردم", "کردی", "کردند", "می‌کند", "نمی‌کند", "شد", "شدم", "شدند", "گرفت", "گرفتم", "گرفتند", "داد", "دادم", "دادند", "داشت", "داشتم", "داشتند", "آورد", "آوردند")
# Verb endings that mark a head.
LIGHT_VERB_HINTS = ("کرد", "شد", "گرفت", "داد", "داشت", "آورد", "رفت", "بود", "است")
# Prefixes and suffixes, in the order in which they are tried.
PREFIXES = ("نمی‌", "می‌", "بی‌", "هم‌")
SUFFIXES = ("هایمان", "هایتان", "هایشان", "هایی", "های", "ها", "ترین", "تر", "مان", "تان", "شان", "ام", "ات", "اش")
ROOT_SUFFIXES = ("هایم", "هایت", "هایش", "هایمان", "هایتان", "هایشان", "ها", "ام", "ات", "اش", "مان", "تان", "شان", "ی", "م")
# Stop words.
STOP_WORDS = (
    "", "،", ".", "؛", ":", "؟", "!", "از", "اگر", "اما", "اند", "است", "باشد", "باشند", "این", "آن", "او", "من", "تو", "با", "به", "برای", "بر", "پس", "سپس", "چو", "چون", "کدام", "ز", "دگر",
    "تا", "در", "را", "شد", "شود", "شده", "کرده", "کند", "کنند", "قابل", "نماند", "تواند", "توانند", "که", "کرد", "می", "می‌کند", "می‌کنند", "می‌تواند", "می‌توانند", "نمی‌کند", "گفتم", "بود",
    "ام", "ات", "اش", "مان", "تان", "شان", "هم", "نیز", "و", "یا", "یک", "ها", "های", "هایی", "تر", "ترین",
)
# Node types that are no concepts.
NODE_TYPES_WITHOUT_CONCEPT = ("doc", "document", "sentence", "topic", "context")
# Nouns that open a name.
NAME_NOUNS = ("شرکت", "سازمان", "دانشگاه", "وزارت", "پژوهشگاه", "مرکز", "دکتر", "مهندس")
# Prefixes that belong to the verb after them.
VERB_PREFIXES = ("می", "نمی")
# Labels that count as hate and as normal.
HATE_LABELS = ("1", "true", "hate", "hateful", "toxic", "نفرت")
NORMAL_LABELS = ("0", "false", "normal", "safe", "neutral", "عادی")
# Punctuation that augmentation drops.
AUGMENT_PUNCTUATION = "[،؛:,.!?؟]+"
# Tokens that stand for no text, by id.
SPECIAL_TOKENS = ("<pad>", "<unk>", "<bos>", "<eos>", "<mask>")

# White space as Python's str.split() sees it, as a character class that Java and RE2 read alike.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Words: a letter with letters, digits and underscores after it, or a run of digits.
WORD = r"\p{L}[\p{L}\p{N}_]*|\p{N}+"
WORD_RUN = r"[\p{L}\p{N}_]+"
# Letters and punctuation of the language-model pre-tokenizer.
LM_LETTERS = r"\x{621}-\x{655}\x{670}-\x{6d3}\x{6d5}-\x{6ff}"
LM_PUNCTUATION = r"\x{60c}\x{61b}\x{61f}\x{61e}\x{6d4}\x{66a}\x{66b}\x{66c}\x{ab}\x{bb}\x{2026}.,:;!?()\[\]{}\"'/%\x{2014}\x{2013}\-"
LM_TOKEN = rf"[{LM_LETTERS}]+(?:\x{{200c}}[{LM_LETTERS}]+)*|[A-Za-z]+|\p{{Nd}}+(?:[.,/]\p{{Nd}}+)*|[{LM_PUNCTUATION}]"
ARABIC_BLOCK = r"\x{600}-\x{6ff}"
# Sentence ends of the four splitters.
SENTENCE_RUNS = r"[^.!?؟؛…]+"
SUMMARY_END = r"[.!؟۔]"
GRAPH_END = r"[.!؟?؛\n]+"
# Punctuation that is joined again when tokens are decoded.
CLOSING = r"\x{60c}\x{61b}\x{61f}\x{61e}\x{6d4}\x{66a}\x{2026}.,:;!?)\]}\x{bb}%"
OPENING = r"\x{ab}(\[{"
