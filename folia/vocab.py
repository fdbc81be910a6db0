"""Vocabularies, thresholds and patterns that results must share."""

# What was done to a file, why, and what happened to its text layer.
COMPRESSED, KEPT, FAILED, PROCESSED = "compressed", "kept original", "FAILED", "processed"
BORN_DIGITAL, LOSSLESS, SMALL, ALREADY, COMPRESSIBLE, ERROR = (
    "born digital", "lossless rewrite", "small size", "already compressed", "compressible", "error")
OCR_NONE, OCR_KEPT, OCR_NEW, OCR_REDO, OCR_FAILED, OCR_NA = "not requested", "kept existing", "new ocr", "re-ocr", "failed", ""
OCR_RAN = (OCR_NEW, OCR_REDO, OCR_FAILED)
OCR_ADDED = (OCR_NEW, OCR_REDO)

PAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp", "pdf")

# Front matter: rank by key word, the names that rank only when bare, and the
# letters a ranked name may have besides its key word.
LEAD_WORDS = ((0, ("cover",)), (1, ("foreword", "title")), (2, ("index", "contents")))
LEAD_BARE = {"fwd": 1}
LEAD_SPARE_LETTERS = 10

# Boilerplate lines of a file: least pages with text, their share, most lines and characters.
BOILER_PAGES, BOILER_SHARE, BOILER_LINES, BOILER_CHARS = 3, 0.9, 4, 400

# Text gates.
SAMPLE_PAGES, SEARCHABLE_CHARS, SEARCHABLE_SHARE = 8, 40, 0.8
SCAN_SHARE, TEXT_PAGE_CHARS, SCAN_DPI = 0.5, 100, 50
TRIAGE_PAGES = 6

# Levels of forms that are looked into for visible text.
FORM_DEPTH = 4

# Scripts: least letters and share, ranges, packs, least confidence of a vote.
SCRIPT_LETTERS, SCRIPT_SHARE, SCRIPT_CONFIDENCE = 50, 0.20, 3.0
SCRIPT_CLASSES = (("Cyrillic", r"[\x{0400}-\x{052F}]"), ("Japanese", r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{FF66}-\x{FF9D}]"))
SCRIPT_PACKS = {"Cyrillic": "rus+eng", "Latin": "eng", "Japanese": "jpn+eng", "Han": "jpn+eng", "HanS": "jpn+eng", "HanT": "jpn+eng", "Katakana": "jpn+eng", "Hiragana": "jpn+eng"}

# Gates on size.
PRECHECK_PAGES, PRECHECK_RATIO, LOSSLESS_SAVING = 100, 0.75, 0.03

# Bands and windows of pages.
SHARD_PAGES, SEEK_PAGES = 50, 1000

# Audits.
RECALL_WORDS, RECALL_FATAL, RECALL_WARN, RECALL_FLAG = 50, 0.5, 0.8, 0.6

# Page kinds and the ladder's thresholds.
PAGE_KINDS = ("vector", "photo_color", "photo_gray", "color_line", "blank", "line")
BLANK_INK = 0.0008

REPORT_COLUMNS = ("file", "action", "reason", "ocr", "language", "orig size (MB)", "new size (MB)", "%", "duplicate of", "page types", "scan signals", "note", "warnings", "error")

# Columns of the other reports.
REVIEW_COLUMNS = ("name", "src", "mb_b", "mb_a", "pct", "pages", "words_b", "words_a", "text_recall", "links", "bm", "colour_px", "flags")
AUDIT_COLUMNS = ("file", "MB before", "MB after", "%", "xmp", "hint", "orphans", "lost", "added", "xmp_replaced", "pixels", "text", "verdict", "detail")
FOLDER_COLUMNS = ("folder", "pdfs", "scanned", "born_digital", "errors", "junk_pdf", "big", "no_ocr", "other_files", "only_pdfs", "total_MB", "scanned_MB", "compressible_MB", "biggest_MB", "reasons")
FILE_COLUMNS = ("path", "size_MB", "scanned", "born_digital", "has_ocr", "pages", "scan_frac", "error")
MATRIX_COLUMNS = ("type", "fixture", "combo", "orig_bytes", "out_bytes", "pct_of_orig", "raw_black_frac", "ink_kept_frac")

# Words of a note.
DECRYPTED_NOTE = "source was encrypted; output is DECRYPTED and its owner permission flags are dropped (page content unchanged and still verified)"
