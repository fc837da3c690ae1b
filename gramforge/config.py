"""Parameters of phrase mining."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .functions.patterns import negative_patterns, positive_patterns

#: Characters deleted before n-grams are taken, by code point: braille blank,
#: spaces, line ends, full stops, colons, exclamation and question marks,
#: half-width kana marks, slashes and Japanese brackets.
DEFAULT_REMOVES = "".join(
    map(
        chr,
        [0x0A, 0x0D, 0x20, 0x21, 0x23, 0x2A, 0x2E, 0x2F, 0x3F, 0x2026, 0x2800, 0x3000, 0x3001]
        + [*range(0x300C, 0x3012)]
        + [0xFF01, 0xFF0F, 0xFF1A, 0xFF1F, 0xFF3C, 0xFF5E, 0xFF65, 0xFF70, 0xFFE3, 0xFFFD],
    )
)

#: Regular expressions; a phrase in which one is found is junk.
DEFAULT_UNNECESSARY = ("&gt;", "&amp;", "www", "http", "ｗ" * 3)


@dataclass(frozen=True)
class PhraseConfig:
    """All settings of :class:`gramforge.plans.miner.PhraseMiner`.

    size_sentence None makes the corpus one batch. selection 0 returns phrases
    as they are ranked, without pattern, length and periodicity filters.
    max_length -2 takes grams of up to half as many characters as a batch has
    sentences; below 0, no phrase is short enough for a selection. verbose 1 logs
    the leading phrases after each batch, and the stages; 0 logs nothing and saves
    the pass over the batches.
    """

    min_count: int = 6
    min_length: int = 4
    max_length: int = 16
    weight_freq: float = 1.0
    weight_len: float = 1.0
    removes: str | tuple[str, ...] = DEFAULT_REMOVES
    unnecessary: tuple[str, ...] = DEFAULT_UNNECESSARY
    threshold_originality: float = 0.5
    size_sentence: int | None = 5000
    knowns: tuple[str, ...] = ()
    selection: int = 1
    verbose: int = 0
    positive: dict[str, str] = field(default_factory=positive_patterns)
    negative: dict[str, str] = field(default_factory=negative_patterns)
    len_period: int = 2

    def __post_init__(self):
        if isinstance(self.knowns, str):
            raise TypeError("knowns is a list of terms, not one string")
        if any(k == "" for k in self.knowns):
            raise ValueError("an empty known term occurs everywhere")
        object.__setattr__(self, "knowns", tuple(self.knowns))
        object.__setattr__(self, "unnecessary", tuple(self.unnecessary))

    def but(self, **changes) -> PhraseConfig:
        return replace(self, **changes)

    @property
    def longest(self) -> int:
        """Grams are taken one character longer than phrases are returned, so
        that a cut-off phrase is contained in its own extension."""
        return self.max_length + 1

    @property
    def half_batch(self) -> bool:
        """Whether grams are as long as half a batch has sentences."""
        return self.longest == -1
