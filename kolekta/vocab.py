"""Controlled vocabularies of the receivables domain.

What stands between the FIXED VALUES marks must equal the business rules the
dashboard was specified with (status words, aging labels, invoice categories,
aging brackets, sheet names, action-plan rows). They are plain data: every
operator takes them as parameters with these as defaults, so a user can swap a
vocabulary without touching code.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference's business rules verbatim)
# ---------------------------------------------------------------------------

# Collection status ("status_tagih").
LAYAK = "AR LAYAK TAGIH"                # collectible
BERMASALAH = "AR BERMASALAH"            # problematic
TIDAK_LAYAK = "AR TIDAK LAYAK TAGIH"    # uncollectible
STATUSES = (LAYAK, BERMASALAH, TIDAK_LAYAK)

# Aging buckets stored on the fact table.
WITHIN_DUE = "Within Due"
AGING_BUCKETS = ("Within Due", "0-30 Days", "31-60 Days", "61-90 Days", ">90 Days")

# Invoice categories, in their ordinal order: one invoiced, seven not yet.
SUDAH_CATS = ("SUDAH INVOICE",)
BELUM_CATS = ("KONTRAK", "BAST/BAPP", "REKON/SLG", "TERMYN", "PROSES IDENTIFIKASI", "KOREKSI", "CHECKER")
CATEGORIES = SUDAH_CATS + BELUM_CATS
SUDAH_INVOICE = "SUDAH INVOICE"
BELUM_INVOICE = "BELUM INVOICE"

# Aging bracket (column offset inside a category range) -> (sheet label, aging bucket, status).
BRACKETS = (
    (0, "Aging >24 Bln", ">90 Days", "AR TIDAK LAYAK TAGIH"),
    (1, "Aging 13-24 Bln", ">90 Days", "AR TIDAK LAYAK TAGIH"),
    (2, "Aging 7-12 Bln", "61-90 Days", "AR BERMASALAH"),
    (3, "Aging 4-6 Bln", "31-60 Days", "AR BERMASALAH"),
    (4, "Aging 1-3 Bln", "0-30 Days", "AR BERMASALAH"),
    (5, "Aging 0 Bln", "Within Due", "AR LAYAK TAGIH"),
)
BRACKETS_PER_CATEGORY = 6

# Workbook sheet name -> report month; the workbook order decides which sheet wins a month.
SHEET_MONTHS = (
    ("Detail", "Agustus 2026"),
    ("OI 202608", "Agustus 2026"),
    ("Sheet Update Nilai AR (Tio)", "Agustus 2026"),
    ("Update Nilai AR (Tio Juli)", "Juli 2026"),
    ("OI 202607", "Juli 2026"),
    ("OI 202606", "Juni 2026"),
)

# Action plan: (ord, kategori, uic, tindak_lanjut, due_date).
ACTION_PLAN = (
    (1, "AR TIDAK LAYAK TAGIH", "SEGMEN", "Dorong DO/Adjustment Negatif", "Q4"),
    (2, "REGIONAL", "CGA, SEGMEN & REGIONAL", "Monthly rekonsiliasi forum collection", "MONTHLY"),
    (3, "SUDAH INVOICE", "CGA & PELANGGAN", "Proses Bayar / Reminding", "JUNI 2026"),
    (4, "KONTRAK", "SEGMEN, LEGAL & PELANGGAN", "Percepatan penyelesaian kontrak", "Q3"),
    (5, "BAST/BAPP", "CCA, SEGMEN, PELANGGAN", "Proses BAST/BAPP", "Q3"),
    (6, "REKON/SLG", "Segmen, Pelanggan & CGA", "Rekonsiliasi SLG", "Q3"),
    (7, "TERMYN", "Segmen, CCA", "Proses Termin", "Q3"),
    (8, "PROSES IDENTIFIKASI", "CCA & SEGMEN", "Identifikasi & validasi tagihan", "JUNI 2026"),
)

# Age-analysis chart: (ord, label, column, value) -- a status sum or an aging-bucket sum.
AGE_ANALYSIS = (
    (1, "AR Layak Tagih", "status_tagih", "AR LAYAK TAGIH"),
    (2, "AR Bermasalah", "status_tagih", "AR BERMASALAH"),
    (3, "AR Tidak Layak Tagih", "status_tagih", "AR TIDAK LAYAK TAGIH"),
    (4, "Within Due", "aging_category", "Within Due"),
    (5, "Over Due 0-30 Days", "aging_category", "0-30 Days"),
    (6, "Over Due 31-60 Days", "aging_category", "31-60 Days"),
    (7, "Over Due 61-90 Days", "aging_category", "61-90 Days"),
    (8, "Due Over 90 Days", "aging_category", ">90 Days"),
)

# Identity columns of an open-item sheet: (sheet header, fact column, max length).
IDENTITY_COLUMNS = (
    ("NAME", "customer_name", 100),
    ("CA", "ca", 30),
    ("BP NUM", "bp_num", 30),
    ("NIPNAS", "nipnas", 30),
    ("PENGELOLAAN", "pengelolaan", 10),
    ("AREA", "region", 50),
    ("WITEL", "witel", 50),
    ("SATKER", "satker", 100),
    ("REG", "reg", 50),
)
UIC_MAX, UIC_DEFAULT = 50, "ERS"
ACTION_MAX, ACTION_DEFAULT = 200, "Normal collection"
DSO_CONSTANT = 60

# Defaults of the file-cleaning step.
CLEAN_AGING_DEFAULT = "Within Due"
CLEAN_STATUS_DEFAULT = "AR LAYAK TAGIH"

# Home region of the flow split, compared after lower(trim()).
HOME_REGION = "jakarta"

# ---------------------------------------------------------------------------
# END OF FIXED VALUES
# ---------------------------------------------------------------------------

# Dashboard paging / display sizes.
PAGE_SIZE = 25
TOP_CUSTOMERS = 20
TABLE_HEAD = 200
BAND_HIGH, BAND_MEDIUM = 80, 50

# Columns searched by the detail-table search box.
SEARCH_COLUMNS = ("customer_name", "pengelolaan", "region", "invoice_status", "status_tagih", "bp_num", "nipnas")

# Columns of the detail table, in display order.
DETAIL_COLUMNS = (
    "customer_name", "bp_num", "nipnas", "pengelolaan", "region", "witel",
    "invoice_status", "status_tagih", "aging_category", "nilai_m", "uic", "report_month",
)

# Month names (Indonesian and English, full and short) -> month number.
MONTH_NAMES = (
    ("januari", 1), ("january", 1), ("jan", 1),
    ("februari", 2), ("february", 2), ("feb", 2),
    ("maret", 3), ("march", 3), ("mar", 3),
    ("april", 4), ("apr", 4),
    ("mei", 5), ("may", 5),
    ("juni", 6), ("june", 6), ("jun", 6),
    ("juli", 7), ("july", 7), ("jul", 7),
    ("agustus", 8), ("august", 8), ("aug", 8), ("agu", 8), ("agt", 8),
    ("september", 9), ("sep", 9), ("sept", 9),
    ("oktober", 10), ("october", 10), ("oct", 10), ("okt", 10),
    ("november", 11), ("nov", 11), ("nop", 11),
    ("desember", 12), ("december", 12), ("dec", 12), ("des", 12),
)
