"""Settings and fixed values.

Every tunable number lives in :class:`Settings` (a frozen dataclass, so a
plan built with one instance cannot change under it).  Values that must equal
the original pipeline's for the same results are grouped at the bottom under
``FIXED VALUES``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    # corpus cleaning
    min_article_words: int = 30
    min_summary_words: int = 3
    max_article_words: int | None = 2000  # 0 / None disables the cap

    # summaries (K5)
    default_k: int = 3

    # TF-IDF vocabulary pruning
    max_df: float = 0.85
    min_df_plain: int = 2
    min_df_hybrid: int = 1

    # PageRank (G4)
    damping: float = 0.85
    tol: float = 1e-6
    max_iter: int = 100
    checkpoint_every: int = 8  # iterative jobs cut lineage this often

    # weak labels (M2)
    label_threshold: float = 0.3

    # training (M8-M10)
    epochs: int = 20
    validation_split: float = 0.2
    patience: int = 3
    random_state: int = 42
    hidden_layers: tuple = (64, 32)

    # logs (T15)
    preview_chars: int = 100

    # physical plan
    broadcast_max_rows: int = 1_000_000  # largest side we agree to broadcast

    def with_(self, **kw) -> "Settings":
        return replace(self, **kw)


DEFAULT = Settings()

# ----------------------------------------------------------------------------
# FIXED VALUES — must equal the original pipeline's for the same results.
# ----------------------------------------------------------------------------

# News-agency prefixes removed from articles, tried in this order; the first
# pattern that matches removes one prefix (Python/Java regex syntax; ``\s`` is
# replaced by the Unicode whitespace class below before use).
NEWS_PREFIX_PATTERNS = (
    r"^\s*\([A-Za-z]+\)\s*[-–—]+\s*",
    r"^\s*[A-Z][A-Za-z\.\'\- ]+(?:,\s*[A-Z][A-Za-z\.\'\- ]+){0,2}\s*\([A-Za-z]+\)\s*[-–—]+\s*",
    r"^\s*[A-Z][A-Za-z\.\'\- ]+\s*-\s*",
)
URL_PATTERN = r"https?://\S+|www\.\S+|ftp://\S+"
EDITOR_NOTE_PATTERN = r"Editor's note:.*?(?=\.\s|$)"
COPYRIGHT_PATTERN = r"Copyright\s+\d{4}\s+.*?All rights reserved\.?"
PROMO_PATTERN = r"Read more\.?|Click here\.?|Watch now\.?"
PUNCT_SPACING_PATTERN = r"([.!?])([A-Z])"

# Python's str.isspace() set, i.e. what ``\s`` and ``str.split()`` mean in the
# original code.  Java's ``\s`` and RE2's ``\s`` are ASCII-only, so every
# pattern uses this class instead.
WS_CLASS_BODY = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS = "[" + WS_CLASS_BODY + "]"
NON_WS = "[^" + WS_CLASS_BODY + "]"

# Words that do not end a sentence when followed by a dot.
ABBREVIATIONS = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "vs", "etc", "e.g", "i.e",
    "U.S", "U.K", "Inc", "Ltd", "Co", "Gen", "Sen", "Rep", "Gov",
    "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec",
    "No",
)

# Porter stemmer irregular forms (NLTK extension mode): form -> stem.
STEM_IRREGULAR = (
    ("skies", "sky"), ("sky", "sky"), ("dying", "die"), ("lying", "lie"),
    ("tying", "tie"), ("news", "news"), ("innings", "inning"), ("inning", "inning"),
    ("outings", "outing"), ("outing", "outing"), ("cannings", "canning"),
    ("canning", "canning"), ("howe", "howe"), ("proceed", "proceed"),
    ("exceed", "exceed"), ("succeed", "succeed"),
)

MODEL_NAMES = {"tfidf": "TF-IDF", "textrank": "TextRank", "hybrid": "Hybrid DL", "lead": "Lead"}


def html_entities() -> dict[str, str]:
    """HTML 5 names with their characters, from the standard library's table (names that end in a semicolon)."""
    from html.entities import html5

    return {k[:-1]: v for k, v in html5.items() if k.endswith(";")}


# The English stop words of Spark ML's StopWordsRemover.
ENGLISH_STOP_WORDS = tuple((
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll "
    "we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've "
    "they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't "
    "mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's "
    "would "
).split())


def english_stop_words() -> tuple[str, ...]:
    return ENGLISH_STOP_WORDS
