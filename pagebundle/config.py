"""Parameters that change results or physical layout."""

from __future__ import annotations

from dataclasses import dataclass

from pagebundle import fixed


@dataclass(frozen=True)
class SplitConfig:
    # acceptance thresholds
    min_auto_accept_confidence: float = 0.80
    min_review_confidence: float = 0.70
    # text acquisition
    ocr_enabled: bool = True
    ocr_min_text_chars: int = 25
    blank_max_ink_ratio: float = 0.002
    blank_margin_ratio: float = 0.04
    dark_threshold: int = 200
    # blank-page handling
    empty_page_mode: str = "keep"
    empty_page_max_alnum: int = 0
    empty_page_max_share: float = 0.5
    # page diagnostics
    log_page_text: bool = True
    raw_preview_chars: int = 1200
    norm_preview_chars: int = 300
    # rule scoring
    header_zone_chars: int = 1200
    header_weight: float = 0.80
    phrase_weight: float = 0.10
    first_page_threshold: float = 0.70
    unknown_threshold: float = 0.50
    # job log
    max_queue_size: int = 50
    job_result_ttl_seconds: int = 3600
    max_attempts: int = 3
    # physical layout: a bundle longer than this is worked on in several blocks
    block_pages: int = 4096
    # dictionaries above either bound are joined by chunks instead of embedded
    max_embedded_patterns: int = 20_000
    # up to this many headers, phrases and exclusions become column expressions
    max_compiled_terms: int = 400
    max_embedded_chars: int = 8_000_000

    @property
    def empty_mode(self) -> str:
        """Unknown modes fall back to the one that never removes anything."""
        mode = (self.empty_page_mode or "").strip().lower()
        return mode if mode in fixed.EMPTY_PAGE_MODES else "keep"
