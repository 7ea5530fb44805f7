"""Text Column builders and the fixed word lists they use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stopword list of the reference's text stage (NLTK 'english'),
# in its published order, plus the nine domain words the reference adds.
ENGLISH_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll",
    "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's",
    "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "that'll", "these", "those", "am",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of",
    "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should",
    "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn",
    "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven",
    "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't",
    "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't",
    "wouldn", "wouldn't",
]
DOMAIN_STOPWORDS = ["product", "order", "delivery", "item", "received", "arrived", "good", "great", "excellent"]

# Rule-based sentiment constants (Hutto & Gilbert 2014).  Only entries
# made of the letters a-z are listed: cleaning removes apostrophes, hyphens and
# spaces inside words, so the other published entries can never match a token.
BOOSTER_INCREMENT = 0.293
BOOSTER_DECREMENT = -0.293
NEGATION_SCALAR = -0.74
NORMALIZE_ALPHA = 15.0
BOOSTERS_UP = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply", "effing",
    "enormously", "entirely", "especially", "exceptionally", "extremely", "fabulously", "flipping",
    "flippin", "fricking", "frickin", "frigging", "friggin", "fully", "fucking", "greatly", "hella",
    "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most", "particularly", "purely",
    "quite", "really", "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously",
    "uber", "unbelievably", "unusually", "utterly", "very",
]
BOOSTERS_DOWN = [
    "almost", "barely", "hardly", "kinda", "kindof", "less", "little", "marginally", "occasionally",
    "partly", "scarcely", "slightly", "somewhat", "sorta", "sortof",
]
NEGATORS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "dont", "hadnt", "hasnt",
    "havent", "isnt", "mightnt", "mustnt", "neither", "neednt", "never", "none", "nope", "nor", "not",
    "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent", "without", "wont",
    "wouldnt", "rarely", "seldom", "despite",
]
# Sentiment class cut points on the compound score.
POSITIVE_AT = 0.05
NEGATIVE_AT = -0.05


def clean_text(c: Column) -> Column:
    """Null -> '', lower case, drop URLs, drop everything but a-z and
    whitespace (accented letters are deleted, not folded), squeeze whitespace
    to one blank, trim.  (?U) makes \\s and \\S Unicode-aware as in Python."""
    x = F.lower(F.coalesce(c, F.lit("")))
    x = F.regexp_replace(x, r"(?U)http\S+|www\S+", "")
    x = F.regexp_replace(x, r"(?U)[^a-zA-Z\s]", "")
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    return F.trim(x)


def words(c: Column) -> Column:
    """Blank-separated words of a cleaned text (no empty strings)."""
    return F.filter(F.split(c, " "), lambda w: F.length(w) > 0)


def sentiment_class(score: Column) -> Column:
    """N4."""
    return (F.when(score >= POSITIVE_AT, "Positive").when(score <= NEGATIVE_AT, "Negative")
            .otherwise("Neutral"))
