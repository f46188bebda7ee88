"""Fixed values that must equal the original review pipeline's for equal results.

Everything in this module is data, not logic: marker tokens, the emoji and
slang vocabularies, the key tokens and key-word patterns used to pick
"signal" sentences, and the default parameters of the preparation jobs.
Patterns are written in the Python/Java regex dialect; callers add the
``(?U)`` / ``(?iU)`` flags so that ``\\b \\w \\d \\s`` are Unicode-aware.
"""

# --- fixed values: marker tokens -------------------------------------------
URL_TOKEN = " [URL] "
EMAIL_TOKEN = " [EMAIL] "
PHONE_TOKEN = " [PHONE] "
STRONG_EXCL_TOKEN = " [STRONG_EXCL] "
STRONG_QUEST_TOKEN = " [STRONG_QUEST] "
ALL_CAPS_PREFIX = "[ALL_CAPS] "
ENGLISH_PREFIX = "[EN] "
LOW_SCORE = "[LOW_SCORE]"
MID_SCORE = "[MID_SCORE]"
HIGH_SCORE = "[HIGH_SCORE]"

# --- fixed values: base cleaning patterns ----------------------------------
HTML_TAG_RE = r"<[^>]+>"
URL_RE = r"(https?://\S+|www\.\S+)"
EMAIL_RE = r"\b[\w\.-]+@[\w\.-]+\.\w+\b"
PHONE_RE = r"\b(\+?\d[\d\-\s]{6,}\d)\b"
STRONG_EXCL_RE = r"!{3,}"
STRONG_QUEST_RE = r"\?{3,}"
MULTI_PUNCT_RE = r"([!?.,])\1{2,}"
STRETCH_RE = r"([A-Za-zА-Яа-яЁё])\1{2,}"
LATIN_RE = r"[A-Za-z]"
SENTENCE_END_RE = r"[.!?…]"

# rating phrases: (pattern, scale); the number is group 1
RATING_10_RES = [
    (r"\b(\d{1,2})\s*из\s*10\b", 10),
    (r"\b(\d{1,2})\s*/\s*10\b", 10),
]
RATING_5_RES = [
    (r"\b(\d)\s*из\s*5\b", 5),
    (r"\b(\d)\s*/\s*5\b", 5),
]
STARS_RE = r"[★⭐]{2,5}"
# band limits on the 10-point value: <= LOW_MAX is low, >= HIGH_MIN is high
RATING_LOW_MAX = 4
RATING_HIGH_MIN = 7

# --- fixed values: emoji classes, in application order ---------------------
EMOJI_CLASSES = [
    ("[😊🙂😀😁😄😃]", " [SMILE] "),
    ("[😂🤣]", " [LAUGH] "),
    ("[😡🤬😠]", " [ANGER] "),
    ("[😢😭]", " [CRY] "),
    ("[😍❤️💕💖💘💓]", " [LOVE] "),
    ("[🤮🤢]", " [DISGUST] "),
    ("[🙈🙉🙊]", " [FACEPALM] "),
    ("[😎🤩]", " [COOL] "),
    ("[✌👌👍👎]", " [GESTURE] "),
    ("[🍷🍸🍺🥂🍻]", " [DRINK] "),
]

# --- fixed values: slang, case-insensitive, in application order -----------
SLANG_CLASSES = [
    (r"\bфуф+ел\w*\b", " [BAD_QUALITY] "),
    (r"\bговн\w*\b", " [BAD_STRONG] "),
    (r"\bотстой\b", " [BAD] "),
    (r"\bжесть\b", " [WOW] "),
    (r"\bах+\*+\b", " [STRONG] "),
    (r"\bёкарныйбабай\b", " [EXCLAIM] "),
]

# --- fixed values: signal sentences ----------------------------------------
KEY_TOKENS = [
    "[SMILE]", "[LAUGH]", "[ANGER]", "[CRY]", "[LOVE]", "[DISGUST]",
    "[FACEPALM]", "[COOL]", "[GESTURE]", "[DRINK]",
    "[LOW_SCORE]", "[MID_SCORE]", "[HIGH_SCORE]",
    "[BAD]", "[BAD_STRONG]", "[BAD_QUALITY]",
    "[WOW]", "[EXCLAIM]", "[STRONG_EXCL]", "[STRONG_QUEST]",
]
KEY_WORD_PATTERNS = [
    r"\bужас\w*\b",
    r"\bотстой\w*\b",
    r"\bшикарн\w*\b",
    r"\bпрекрасн\w*\b",
    r"\bрекомендую\b",
    r"\bне рекомендую\b",
    r"\bне советую\b",
    r"\bфуф+ел\w*\b",
    r"\bговн\w*\b",
]

# --- fixed values: caps / English detection --------------------------------
CAPS_MIN_WORD_LEN = 4          # words longer than 3 characters
CAPS_RATIO_NUM, CAPS_RATIO_DEN = 3, 10   # share of caps words >= 0.3
ENGLISH_MIN_LATIN = 10

# --- fixed values: sources and labels ---------------------------------------
SOURCE_TOKEN_OPEN = "[SRC_"
NULL_SOURCE_TEXT = "nan"        # str(NaN) in the original
UNKNOWN_SOURCE = "Не указан"    # shown for missing/blank sources in reports
LABELS = (0, 1, 2)

# --- fixed values: job parameters -------------------------------------------
SEED = 42
VAL_SIZE = 0.1
MAX_SAMPLES_PER_SRC = 40000
MAX_TEXT_LEN_TRAIN = 900
MAX_TEXT_LEN_SERVE = 1200
MAX_FIRST_SENTENCES = 3
MAX_AUG_PER_SAMPLE = 1
WORD_DROP_P = 0.05
WORD_SWAP_P = 0.2
MIN_WORDS_FOR_AUG = 4           # augment only texts with more than 3 words
BAR_MIN_HEIGHT = 8.0            # chart bar floor for non-empty classes
SEARCH_SAMPLE_FRACTION = 0.3
SVC_SAMPLE_FRACTION = 0.4
ENSEMBLE_WEIGHT_STEP = 0.05
ENSEMBLE_FOLDS = 5
EARLY_STOP_PATIENCE = 2
SCORING_BATCH_SIZE = 32

# --- fixed values: baselines -------------------------------------------------
SVC_C = 0.1
SVC_MAX_ITER = 3000
SVC_NGRAM, SVC_MAX_FEATURES = (3, 4), 20_000
TREES_NGRAM, TREES_MAX_FEATURES = (3, 5), 30_000
SVD_COMPONENTS = 200
TREES_ROUNDS, TREES_DEPTH, TREES_RATE = 200, 6, 0.1
BASELINE_MIN_DF, BASELINE_MAX_DF = 2, 0.95

# --- fixed values: search space of the logistic regression ----------------------
SEARCH_ANALYZERS = ("word", "char")
SEARCH_NGRAMS = {"word": ((1, 1), (1, 2), (1, 3)), "char": ((3, 5), (3, 6), (3, 7))}
SEARCH_MAX_FEATURES = (30_000, 50_000, 80_000, 120_000)
SEARCH_MIN_DF = (2, 5, 10)
SEARCH_MAX_DF = (0.9, 0.95, 1.0)
SEARCH_C_EXPONENTS = (-3, 2)
SEARCH_MAX_ITER = 1000
SEARCH_TRIALS = 5


# Emoji of Unicode 14 and 15, as ranges of a character class.
NEW_EMOJI = (r"\x{1F6DC}-\x{1F6DF}\x{1F7F0}\x{1F979}\x{1F9CC}\x{1FA75}-\x{1FA77}\x{1FA7B}-\x{1FA7C}"
             r"\x{1FA87}-\x{1FA88}\x{1FAA9}-\x{1FAAF}\x{1FAB7}-\x{1FABD}\x{1FABF}\x{1FAC3}-\x{1FAC5}"
             r"\x{1FACE}-\x{1FACF}\x{1FAD7}-\x{1FADB}\x{1FAE0}-\x{1FAE8}\x{1FAF0}-\x{1FAF8}")
