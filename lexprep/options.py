"""Frozen option objects (the constructor options of the text pipeline)."""

from __future__ import annotations

from dataclasses import dataclass

from lexprep import constants as C


@dataclass(frozen=True)
class CleanOptions:
    """Options of the composite cleaner.

    keep_url=False: HTML -> text (T1). keep_url=True: text with one space
    between nodes plus the last link's terms (T7), titles if keep_title.
    extra_stopwords: the extension list is used by the cleaner; the TF-IDF
    vectoriser uses the plain language list (extend=False).
    """

    keep_url: bool = True
    keep_title: bool = True
    stopword_language: str = "portuguese"
    extend_stopwords: bool = True
    link_domain: str = C.LINK_DOMAIN
    links: str = "last"  # "last" (reference behaviour) or "all"


#: text without links, as the topic and classifier steps use it
PLAIN = CleanOptions(keep_url=False)


@dataclass(frozen=True)
class TopicOptions:
    """Options of vocabulary pruning.

    token_pattern names one of the preset patterns in constants.TOKEN_PATTERNS.
    min_df is an absolute count, max_df a fraction of the corpus size.
    """

    min_df: int = 1
    max_df: float = 0.75
    token_pattern: str = "letter_word"
    clean: CleanOptions = PLAIN
