"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is data, not logic: the contraction table, the
characters of the punctuation class, the code point ranges of the emoji
class, the punctuation string of the token filter and the numeric
constants of the pipeline.  They are stated plainly and in their natural
order; the code that uses them lives in ``text.py``.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: contraction table, in its natural order.  Matching is one
# left-to-right pass of the alternation of the keys in this order, so a key
# whose prefix is an earlier key never matches (e.g. "can't've").
# ---------------------------------------------------------------------------
CONTRACTIONS = [
    ("ain't", "is not"),
    ("aren't", "are not"),
    ("can't", "cannot"),
    ("can't've", "cannot have"),
    ("'cause", "because"),
    ("could've", "could have"),
    ("couldn't", "could not"),
    ("couldn't've", "could not have"),
    ("didn't", "did not"),
    ("doesn't", "does not"),
    ("don't", "do not"),
    ("hadn't", "had not"),
    ("hadn't've", "had not have"),
    ("hasn't", "has not"),
    ("haven't", "have not"),
    ("he'd", "he would"),
    ("he'd've", "he would have"),
    ("he'll", "he will"),
    ("he'll've", "he he will have"),
    ("he's", "he is"),
    ("how'd", "how did"),
    ("how'd'y", "how do you"),
    ("how'll", "how will"),
    ("how's", "how is"),
    ("I'd", "I would"),
    ("I'd've", "I would have"),
    ("I'll", "I will"),
    ("I'll've", "I will have"),
    ("I'm", "I am"),
    ("I've", "I have"),
    ("i'd", "i would"),
    ("i'd've", "i would have"),
    ("i'll", "i will"),
    ("i'll've", "i will have"),
    ("i'm", "i am"),
    ("i've", "i have"),
    ("isn't", "is not"),
    ("it'd", "it would"),
    ("it'd've", "it would have"),
    ("it'll", "it will"),
    ("it'll've", "it will have"),
    ("it's", "it is"),
    ("let's", "let us"),
    ("ma'am", "madam"),
    ("mayn't", "may not"),
    ("might've", "might have"),
    ("mightn't", "might not"),
    ("mightn't've", "might not have"),
    ("must've", "must have"),
    ("mustn't", "must not"),
    ("mustn't've", "must not have"),
    ("needn't", "need not"),
    ("needn't've", "need not have"),
    ("o'clock", "of the clock"),
    ("oughtn't", "ought not"),
    ("oughtn't've", "ought not have"),
    ("shan't", "shall not"),
    ("sha'n't", "shall not"),
    ("shan't've", "shall not have"),
    ("she'd", "she would"),
    ("she'd've", "she would have"),
    ("she'll", "she will"),
    ("she'll've", "she will have"),
    ("she's", "she is"),
    ("should've", "should have"),
    ("shouldn't", "should not"),
    ("shouldn't've", "should not have"),
    ("so've", "so have"),
    ("so's", "so as"),
    ("that'd", "that would"),
    ("that'd've", "that would have"),
    ("that's", "that is"),
    ("there'd", "there would"),
    ("there'd've", "there would have"),
    ("there's", "there is"),
    ("they'd", "they would"),
    ("they'd've", "they would have"),
    ("they'll", "they will"),
    ("they'll've", "they will have"),
    ("they're", "they are"),
    ("they've", "they have"),
    ("to've", "to have"),
    ("wasn't", "was not"),
    ("we'd", "we would"),
    ("we'd've", "we would have"),
    ("we'll", "we will"),
    ("we'll've", "we will have"),
    ("we're", "we are"),
    ("we've", "we have"),
    ("weren't", "were not"),
    ("what'll", "what will"),
    ("what'll've", "what will have"),
    ("what're", "what are"),
    ("what's", "what is"),
    ("what've", "what have"),
    ("when's", "when is"),
    ("when've", "when have"),
    ("where'd", "where did"),
    ("where's", "where is"),
    ("where've", "where have"),
    ("who'll", "who will"),
    ("who'll've", "who will have"),
    ("who's", "who is"),
    ("who've", "who have"),
    ("why's", "why is"),
    ("why've", "why have"),
    ("will've", "will have"),
    ("won't", "will not"),
    ("won't've", "will not have"),
    ("would've", "would have"),
    ("wouldn't", "would not"),
    ("wouldn't've", "would not have"),
    ("y'all", "you all"),
    ("y'all'd", "you all would"),
    ("y'all'd've", "you all would have"),
    ("y'all're", "you all are"),
    ("y'all've", "you all have"),
    ("you'd", "you would"),
    ("you'd've", "you would have"),
    ("you'll", "you will"),
    ("you'll've", "you will have"),
    ("you're", "you are"),
    ("you've", "you have"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: character normalisation before cleaning (from -> to).
# RIGHT SINGLE QUOTATION MARK -> apostrophe, EN DASH -> space, EM DASH -> space.
# ---------------------------------------------------------------------------
PRE_REPLACE = [("’", "'"), ("–", " "), ("—", " ")]

# ---------------------------------------------------------------------------
# FIXED VALUES: members of the punctuation class; a run of any of them
# becomes one space.  Backslash is not a member.
# ---------------------------------------------------------------------------
PUNCT_MEMBERS = (
    '"', "$", "%", "&", "(", ")", "*", "+", "-", "/", ":", "<", "=", ">", "[",
    "]", "^", "_", "`", "'", "”", "“", "’", ";", ",", "{", "|",
    "}", "!", "?", ".", "~", "•", "@", " ", "#", "…", "‘",
    "‼", "™", "»", "«", "®", "⃣",
)

# ---------------------------------------------------------------------------
# FIXED VALUES: code points deleted as emoji.  The union of the listed ranges
# is exactly these four single code points plus one range to the top of
# Unicode.
# ---------------------------------------------------------------------------
EMOJI_SINGLES = (0x200D, 0x231A, 0x23CF, 0x23E9)
EMOJI_RANGE = (0x24C2, 0x10FFFF)

# ---------------------------------------------------------------------------
# FIXED VALUES: the punctuation string of the token filter.  A token that is
# a substring of it is dropped.
# ---------------------------------------------------------------------------
TOKEN_PUNCTUATION = ",.?!()-_\"'\\\n\r\t;:+=*<>@#§^$%&|/`”“’{|}~•[]'"

# ---------------------------------------------------------------------------
# FIXED VALUES: numeric constants of the pipeline.
# ---------------------------------------------------------------------------
MIN_TOKEN_LEN = 3            # tokens of two letters or fewer are dropped
PHRASE_MIN_COUNT = 5         # phrase model min_count
PHRASE_THRESHOLD = 100.0     # phrase model threshold (score must exceed it)
PHRASE_TOKEN_MIN = 2         # phrase tokeniser keeps tokens of 2..15 chars
PHRASE_TOKEN_MAX = 15
PHRASE_EXTRA_STOPWORDS = ("re",)
TOP_TAGS = 20                # tags in the top-tags report
TOPIC_TERMS = 100            # terms listed per topic
LDA_SEED = 1
COHERENCE_TOP_WORDS = 20     # c_v: words per topic
COHERENCE_WINDOW = 110       # c_v: boolean sliding window
COHERENCE_EPS = 1e-12        # c_v: NPMI smoothing
WORDCLOUD_MAX_WORDS = 200    # words kept for the word-frequency table

# ---------------------------------------------------------------------------
# FIXED VALUES: labels of the reports, in their order.
# ---------------------------------------------------------------------------
CORPUS_PROFILE = {
    "tweets": "Tweets",
    "en": "English Tweets",
    "unique_en": "Unique English Tweets (not retweet)",
}
FULL_PROFILE = {
    "columns": "Number of columns",
    "all": "English tweets",
    "rt": "--Retweets (RT)",
    "unique": "--Unique tweets (not RT)",
    "replies": "--Replies",
    "quoting": "--Quoting tweets",
    "rt_quoting": "--RT & quoting",
    "rt_reply": "--RT & reply",
    "rt_not_quoting": "--RT & not quoting",
    "unique_quoting": "--not RT & quoting",
    "unique_reply_only": "--not RT & not quoting & reply",
    "unique_quoting_only": "--not RT & quoting & not reply",
    "unique_plain": "--not RT & not quoting & not reply",
    "unique_both": "--not RT & quoting & reply",
    "any": "--RT or quoting or reply",
    "truncated": "--Truncated tweets",
    "sensitive": "--Tweets with a link referring to a sensitive content",
    "withheld": "--Tweets that their content is removed due to copyright",
    "location": "--Tweets with user specified location text",
    "geo": "--GeoTagged tweets",
    "verified": "--Tweets issued by users with verified accounts",
}
TAG_REPORT = {
    "cleaned": "cleaned tweets",
    "total_tags": "Total hashtags (repetitive) in cleaned tweets",
    "unique_tags": "-- Unique hashtags",
    "total_tags_red": "Total hashtags (repetitive) after removing unpopular hashtags",
    "unique_tags_red": "-- Unique hashtags after removing unpopular hashtags",
    "untagged": "Tweets containing no hashtags",
    "tagged": "Tweets containing at least one hashtag",
    "one": "-- One hashtag per tweet",
    "two": "-- Two hashtags per tweet",
    "three": "-- More than two hashtags per tweet",
    "max_tags": "Maximum number of hashtags used in a tweet",
    "cooccurrences": "Total hashtag co-occurrences after removing unpopular hashtags",
}
