"""Parameters of the reconciliation rules."""

from __future__ import annotations

# Tolerances, scores and thresholds that results depend on.
TOLERANCE_ABS = "0.50"
TOLERANCE_PCT = "0.01"
EXACT_EPSILON = "0.005"
MATCH_CONFIDENCE = {(1, "EXACT"): 1.00, (1, "TOLERANCE"): 0.95, (2, "EXACT"): 0.80, (2, "TOLERANCE"): 0.75}
#: Tiers of kinds that the matcher does not give today.
OTHER_CONFIDENCE = {("INVOICE", "MISMATCH"): 0.70, ("PO", "EXACT"): 0.85, ("PO", "TOLERANCE"): 0.80}
FUZZY_CONFIDENCE = 0.60
EXCEPTION_CONFIDENCE = {"Invoice Missing": 0.90, "Amount Mismatch": 0.85, "EXTRACTION_INCOMPLETE": 0.50}
DEFAULT_CONFIDENCE = 0.50
LINE_CONFIDENCE_MIN = 0.90
FALLBACK_LINE_CONFIDENCE = 0.40
BULK_APPROVE_MIN = 0.85
EXPLAIN_PER_RUN = 10
REASON_LABELS = {
    "Invoice Missing": "missing",
    "Amount Mismatch": "amount mismatch",
    "EXTRACTION_INCOMPLETE": "extraction incomplete",
}

# Header keywords, in the order in which branches are tried.
HEADER_WORDS = ["invoice", "amount", "date", "balance", "due", "outstanding", "ro", "po", "ref", "description", "charges"]
COLUMN_KEYWORDS = [
    ("invoice_number", ["invoice #", "invoice no", "invoice number", "invoice#", "inv #", "inv no", "document no", "sin",
                        "reference"]),
    ("due_date", ["due date"]),
    ("invoice_date", ["invoice date", "posting date", "transaction date", "date"]),
    ("outstanding_amount", ["amount due", "balance", "outstanding", "remaining", "net amount", "unpaid"]),
    ("credit", ["credits", "payments", "credit memo", "credit"]),
    ("amount", ["charges", "purchases", "amount charged", "invoice amt", "debit", "gross amount"]),
    ("ro_number", ["ro #", "ro no", "repair order"]),
    ("po_number", ["po #", "po no", "purchase order"]),
    ("work_order_number", ["work order", "wo #", "wo no"]),
    ("description", ["description", "desc", "notes"]),
    ("shop", ["shop", "location", "store", "branch", "entity"]),
]
TABLE_INVOICE_KEYWORDS = ["invoice #", "invoice no", "invoice number", "inv #", "inv no", "reference"]
TABLE_OUTSTANDING_KEYWORDS = ["outstanding", "balance", "amount due", "remaining"]
#: Further fields of a page table, in the order in which branches are tried.
TABLE_KEYWORDS = [
    ("outstanding_amount", TABLE_OUTSTANDING_KEYWORDS),
    ("amount", ["amount", "charges"]),
    ("ro_number", ["ro #", "ro no", "repair order"]),
    ("po_number", ["po #", "po no", "purchase order"]),
    ("work_order_number", ["work order", "wo #", "wo no"]),
    ("description", ["desc"]),
]
TOTALS_WORDS = ["total", "balance", "subtotal"]

# What a page with hardly any text is, and how far lines of tables and of scans are trusted.
SCANNED_TEXT_BELOW = 500
TABLE_LINE_CONFIDENCE, SCANNED_LINE_CONFIDENCE, NO_LINES_CONFIDENCE = 0.65, 0.50, 0.20
SHOP_WORDS = ("vive", "collision", "auto body", "shop")

# What print-outs of a report hold besides its rows.
PAGE_HEADER_WORDS = ("transaction", "bill type", "date", "document number", "amount", "bill", "type")
REPORT_TITLES = ("netsuite.com", "reportrunner", "payment history by payment")

# Header fields of a payment voucher, on its first page.
VOUCHER_VENDOR = r"Paid To\n(.+)"
VOUCHER_DATE = r"Payment Voucher\nDate\n(\d{1,2}/\d{1,2}/\d{4})"
VOUCHER_CHECK = r"Check #\n?\s*(\S+)"

# Shapes of extracted texts.
ACCOUNT_PREFIX = r"^\s*\d{2}[\s.]?\d{2}\b"
CURRENCY_SHAPE = r"^\(?-?\$?\s*\d[\d,]*\.\d{2}\)?-?$"
DATE_SHAPE = r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$|^\d{1,2}[A-Za-z]{3}\d{2,4}$"
TOKEN_SHAPE = r"^[A-Za-z0-9\-]+$"
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BILL_SHAPE = r"(?i)^Bill(?: Credit)? #(.+)$"

#: Vendor aliases and owners of the fixture vendors (nations); any mapping may be passed instead.
VENDOR_ALIASES = {
    "FIRST_SUPPLIER": ["Nation_1", "NATION_1"],
    "SECOND_SUPPLIER": ["Nation_2, Inc."],
}
SHOP_OWNERS = {
    "NATION_1": ("Shop Manager", "shop@example.com"),
    "NATION_2": ("Owner", None),
    "NATION_3": (None, "owner@example.com"),
}
