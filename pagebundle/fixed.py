"""Texts, names and limits that results must reproduce exactly."""

# --- document types, statuses, modes -------------------------------------------------
UNKNOWN_DOCUMENT_TYPE = "Nieznany typ dokumentu"
UNKNOWN_CONFIDENCE = 0.20
NO_MATCH_SIGNAL = "no_pattern_match"
UNKNOWN_RUN_SIGNAL = "unknown_run"
EMPTY_PAGE_MODES = ("keep", "report", "remove")
WARN_UNKNOWN_MODE = "unknown_empty_page_mode"
WARN_MODE_NEEDS_OCR = "empty_page_mode_needs_ocr"
STATUS_COMPLETED = "completed"
STATUS_REVIEW = "requires_review"
STATUS_FAILED = "failed"

# --- signals (prefixes) ---------------------------------------------------------------
HEADER_SIGNAL = "header_match:"
PHRASE_SIGNAL = "phrase_hits:"
GLUED_SIGNAL = "glued_unknown_page:"
CONTINUATION_SIGNAL = "phrase_continuation:"
VERDICT_SIGNAL = "llm:"

# --- recogniser confusions folded in headers -------------------------------------------
OCR_DIGITS = "015"
OCR_LETTERS = "OIS"

# --- review reasons --------------------------------------------------------------------
REASON_UNKNOWN_TYPE = "nierozpoznany typ dokumentu (zadna regula nie pasowala)"
REASON_LOW_CONFIDENCE = "pewnosc %s ponizej progu auto-akceptacji %s"
REASON_EMPTY_PAGE = "strona %d bez tekstu (rowniez po OCR) - dolaczona automatycznie"
REASON_GLUED_PAGE = "strona %d doklejona bez dopasowania do wzorca (%s)"
REASON_UNKNOWN_PAGE = "strona %d: %s"
DETAIL_EMPTY_PAGE = "strona bez tekstu (rowniez po OCR) - dolaczona automatycznie"
DETAIL_AFFINITIES = "frazy pasuja do: "
DETAIL_NO_AFFINITY = "zadna fraza nie pasuje"
DETAIL_NO_VERDICT = "LLM bez werdyktu"
DETAIL_PROPOSAL = "LLM proponuje %s: '%s' (pewnosc %s)"
DETAIL_KNOWN_KIND = "typ"
DETAIL_NEW_KIND = "nowy typ"
DETAIL_PROBABLE_START = "LLM: prawdopodobnie poczatek nowego dokumentu nieznanego typu"
DETAIL_UNDETERMINED = "LLM: typ nieustalony"
DETAIL_SUGGESTED = ", sugerowane frazy: "
DETAIL_REJECTED = "werdykt LLM odrzucony jako niespojny (%s); "
SUGGESTED_PHRASES_SHOWN = 3

# --- guard reasons ---------------------------------------------------------------------
GUARD_NO_CURRENT = "kontynuacja bez biezacego dokumentu"
GUARD_OTHER_TYPE = "kontynuacja z typem '%s' innym niz biezacy '%s'"
GUARD_NOT_KNOWN = "isKnownType=true dla typu '%s' spoza znanych typow"

# --- warnings --------------------------------------------------------------------------
WARN_UNKNOWN_RANGE = "Strony %d-%d: nierozpoznany dokument"
WARN_GLUED = (
    "Strona %d: brak dopasowania - doklejona do dokumentu '%s', wymagana weryfikacja"
)
WARN_REMOVED = "Usunieto %d pustych stron: %s (z %d)"
WARN_REPORT = "Tryb report: %d stron wyglada na puste (nie usunieto): %s (z %d)"
WARN_BREAKER = (
    "Bezpiecznik: %d z %d stron uznano za puste - nie usunieto nic, sprawdz OCR/render"
)

# --- file names ------------------------------------------------------------------------
DOCUMENT_FILE_NAME = "%s_strony_%03d-%03d.pdf"
SUFFIX_REMOVED = "_bez-stron"
SUFFIX_EXTRACTED = "_strony"
MERGED_NAME = "merged.pdf"

# --- page-range errors -----------------------------------------------------------------
RANGE_EMPTY = "Zakres stron jest pusty"
RANGE_BAD_FRAGMENT = "Nieprawidlowy fragment zakresu: '%s'"
RANGE_REVERSED = "Odwrocony zakres: '%s'"
RANGE_BAD_NUMBER = "Nieprawidlowy numer strony: '%s'"
RANGE_OUTSIDE = "Strona %s poza dokumentem (1-%d)"
REMOVE_ALL_ERROR = "Usuniecie tych stron zostawiloby pusty dokument"
MERGE_NOTHING_ERROR = "Brak plikow PDF do sklejenia"

# --- dictionary and attachment errors -----------------------------------------------------
DICTIONARY_COLUMNS = ("DocumentType", "Header", "Phrases", "ExcludedPhrases", "Weight")
PATTERNS_ERROR = "Invalid patterns payload"
ONLY_PDF_ERROR = "Only PDF files are supported"
NO_PDF_ERROR = "The scan bundle has no PDF attachment."
MANY_PDF_ERROR = (
    "The scan bundle has more than one PDF attachment; source file is ambiguous."
)
ATTACHMENT_BAD_ID = (
    "Pole konfiguracji 'ID zalacznika zrodlowego' musi byc dodatnia liczba calkowita, "
    "otrzymano: '%s'."
)
ATTACHMENT_MISSING = (
    "Nie znaleziono zalacznika o ID %d (nie istnieje albo uzytkownik nie ma do niego "
    "uprawnien)."
)
ATTACHMENT_FOREIGN = (
    "Zalacznik ID %d nalezy do elementu %s, a nie do biezacego (%d). "
    "Sprawdz regule wskazujaca ID zalacznika."
)
ATTACHMENT_NOT_PDF = "Zalacznik '%s' (ID %d) nie jest plikiem PDF."
ENCRYPTED_ERROR = "PDF is encrypted"

# --- job bookkeeping -------------------------------------------------------------------
OUTCOME_DONE = "GOTOWE"
OUTCOME_ERROR = "BLAD"
JOB_UNKNOWN = "Nieznane zadanie"
JOB_NOT_FINISHED = "Zadanie nie jest zakonczone (status: %s)"
TEXT_QUEUED = "%d. w kolejce"
TEXT_RUNNING = "przetwarzanie (%.0f s)"
TEXT_DONE = "%d dok., %d do weryfikacji"
TEXT_LOST_RETRY = "zadanie przepadlo, ponowienie (%d)"
TEXT_FAILED_RETRY = "blad, ponowienie (%d): %s"
TEXT_LOST_LIMIT = "Zadanie %s przepadlo %d raz(y) - limit prob wyczerpany."
TEXT_FAILED_LIMIT = "Zadanie %s zakonczone bledem: %s"
TEXT_BUSY = "splitter zajety, ponowienie"
TEXT_UNREACHABLE = "splitter niedostepny, ponowienie"
TEXT_TIMEOUT = "splitter nie odpowiada, ponowienie"

# --- child comments --------------------------------------------------------------------
COMMENT_HEAD = "Type: %s; pages %d-%d; confidence %.2f; requires review: %s"
COMMENT_REMOVED = "; usunieto puste strony: "
COMMENT_SIGNALS = "; sygnaly: "
COMMENT_REASONS = "; review reasons: "

# --- verdict context -------------------------------------------------------------------
NO_CURRENT_TYPE = "BRAK"
PREVIOUS_CHARS = 2000
CURRENT_CHARS = 4000
NEXT_CHARS = 2000
VERDICT_FORMAT = (
    '{"isFirstPage": true|false, "documentType": "<nazwa typu dokumentu>", '
    '"isKnownType": true|false, "confidence": <liczba od 0.0 do 1.0>, '
    '"reasonCodes": ["<krotki_kod_powodu>"], "suggestedNewPatterns": ["<fraza>"]}'
)

# --- evaluation ------------------------------------------------------------------------
EVAL_MISMATCH = "%s: oczekiwano %s, otrzymano %s"
