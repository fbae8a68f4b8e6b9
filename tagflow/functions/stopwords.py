"""Stop-word lists.

The default is Spark's English list (the words behind
``StopWordsRemover.loadDefaultStopWords("english")``), shipped with the
package as a plain text file so that neither a JVM nor the Spark jars are
needed to read it.  Callers may pass any other list or a one-column table.
"""

from __future__ import annotations

import functools
from importlib import resources


@functools.lru_cache(maxsize=None)
def default_stopwords(lang: str = "english") -> tuple[str, ...]:
    """The packaged list ``stopwords_<lang>.txt``, one word per line."""
    data = resources.files(__package__).joinpath(f"stopwords_{lang}.txt").read_text(encoding="utf-8")
    return tuple(w for w in data.split() if w)


def union_stopwords(*lists) -> tuple[str, ...]:
    """Union of several stop-word lists, first occurrence order kept."""
    seen: dict[str, None] = {}
    for lst in lists:
        for w in lst:
            seen.setdefault(w, None)
    return tuple(seen)
