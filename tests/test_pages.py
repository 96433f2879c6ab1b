"""Page extraction against a plain walk over pages, and the choice of the invoice column by its values."""

from __future__ import annotations

import random
import re

from tallyloom.operators import extraction, pages

SCHEMA = "doc_id string, page_no int, text string, grid array<array<string>>, scan_text string"
HEADER_WORDS = ["invoice", "amount", "date", "balance", "due", "outstanding", "ro", "po", "ref", "description", "charges"]


def field_of(cell):
    h = cell.lower().strip()
    if "date" not in h and (any(k in h for k in ("invoice #", "invoice no", "invoice number", "inv #", "inv no", "reference")) or re.search(r"\bref\b", h)):
        return "invoice_number"
    if "date" in h and ("invoice" in h or "due" in h):
        return "invoice_date" if "invoice" in h else "due_date"
    for name, words in (("outstanding_amount", ("outstanding", "balance", "amount due", "remaining")), ("amount", ("amount", "charges")), ("ro_number", ("ro #", "ro no", "repair order")),
                        ("po_number", ("po #", "po no", "purchase order")), ("work_order_number", ("work order", "wo #", "wo no")), ("description", ("desc",))):
        if any(w in h for w in words):
            return name
    return None


def number(text):
    kept = re.sub(r"[^0-9.\-]", "", text or "")
    try:
        return float(kept)
    except ValueError:
        return None


def walk(doc):
    """(lines, warnings, vendor, shop) of one document; doc: (page_no, text, grid, scan_text) in page order."""
    out, warnings, vendor, shop = [], [], None, None
    for page_no, text, grid, scan in doc:
        stripped = [s.strip() for s in (text or "").split("\n") if s.strip()]
        if page_no == 1:
            vendor = stripped[0] if stripped else None
            shop = next((s for s in stripped if any(k in s.lower() for k in ("vive", "collision", "auto body", "shop"))), None)
        table, scanned = grid, False
        if not table or len(table) < 2:
            if len((text or "").strip()) >= 500:
                warnings.append(("UNSUPPORTED_LAYOUT", "MEDIUM", page_no))
                continue
            if scan is None:
                warnings.append(("OTHER", "MEDIUM", page_no))
                continue
            if len(scan.strip()) < 500:
                warnings.append(("UNSUPPORTED_LAYOUT", "MEDIUM", page_no))
                continue
            table, scanned = [], True
            for line in filter(None, map(str.strip, scan.split("\n"))):
                cells = re.split(r"\s{2,}", line)
                table.append(line.split() if len(cells) == 1 else cells)
            if len(table) < 2:
                warnings.append(("AMBIGUOUS_COLUMN", "HIGH", page_no))
                continue
        at = next((k for k, row in enumerate(table) if row and sum(w in " ".join(c or "" for c in row).lower() for w in HEADER_WORDS) >= 2), None)
        if at is None:
            warnings.append(("AMBIGUOUS_COLUMN", "HIGH", page_no))
            continue
        places = {}
        for k, cell in enumerate(table[at]):
            name = field_of(cell) if cell else None
            if name and not (name == "amount" and name in places):
                places[name] = k
        for n, row in enumerate(table[at + 1 :], start=1):
            got = {f: row[k].strip() for f, k in places.items() if k < len(row) and row[k]}
            invoice, due = got.get("invoice_number"), got.get("outstanding_amount")
            if (not invoice and not due) or (invoice and any(w in invoice.lower() for w in ("total", "balance", "subtotal"))):
                continue
            due = number(due)
            out.append((page_no, n, invoice, due, number(got.get("amount")) or due, got.get("ro_number"), got.get("description"), 0.5 if scanned else 0.65))
    return out, warnings, vendor, shop


def random_page(rng, page_no):
    heads = rng.sample(["Invoice No", "Txn Ref", "Invoice Date", "Reference Date", "Due Date", "Amount Due", "Balance", "Amount", "Charges", "RO #", "Desc.", "Extra", "", None], rng.randrange(1, 6))
    value = lambda: rng.choice(["A-1", "", None, "12.50", "$1,000.00", "(3.00)", "Sub-Total", "TOTAL", "0.00", " x y ", "1-2", "zz"])
    grid = [[value() for _ in range(rng.randrange(5))] for _ in range(rng.randrange(3))] + [heads] + [[value() for _ in range(rng.randrange(1, 7))] for _ in range(rng.randrange(5))]
    text = rng.choice([None, "", " \n Vendor Co \nEast Collision \nmore", "only vendor", "long " * 120, " \n" * 300])
    spelt = "\n".join("  ".join(c or "-" for c in row) for row in grid)
    scan = rng.choice([None, spelt, spelt + "  " + "y" * 500, "z" * 600, "a b\n" * 200, "Invoice No  Amount Due\nA 5\n" + "q " * 300])
    return page_no, text, rng.choice([grid, grid, grid[:1], None, []]), scan


def test_lines_and_warnings_equal_a_plain_walk(spark):
    rng, docs = random.Random(6), {}
    for d in range(60):
        docs[f"d{d}"] = [random_page(rng, k) for k in range(1, rng.randrange(1, 6))]
    rows = [(d, *page) for d, doc in docs.items() for page in doc]
    decided = pages.decide(spark.createDataFrame(rows, SCHEMA)).cache()
    found = pages.lines(decided)
    got, want, warned, kinds = [], [], {}, set()
    for r in found.collect():
        got.append((r["doc_id"], r["page_no"], r["row_no"], r["invoice_number"], r["outstanding_amount"], r["amount"], r["ro_number"], r["description"], r["line_confidence"], r["shop"]))
    for d, doc in docs.items():
        out, warnings, vendor, shop = walk(doc)
        want += [(d, *o, shop) for o in out]
        if doc:
            total = round(sum(o[3] or 0 for o in out), 2) if out else None
            warned[d] = (vendor, shop, len(out), total, 0.65 if out else 0.2, warnings)
            kinds |= {w[0] for w in warnings}
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 40
    result = {r["doc_id"]: (r["vendor"], r["shop"], r["n_lines"], None if r["total"] is None else float(r["total"]), r["confidence"], [(w["code"], w["severity"], w["page_no"]) for w in r["warnings"]])
              for r in pages.documents(decided, found).collect()}
    assert result == warned and kinds == {"UNSUPPORTED_LAYOUT", "OTHER", "AMBIGUOUS_COLUMN"}
    decided.unpersist()


def test_the_cleanest_invoice_column_is_taken(spark):
    heads = [(1, 0, "Invoice #"), (1, 1, "Reference"), (1, 2, "Date"), (2, 0, "Invoice No"), (2, 1, "Inv #"), (3, 0, "Inv No"), (3, 1, "Invoice #"), (4, 0, "Invoice #")]
    values = [(1, 0, "Invoice #", k, "60 35 8923821" if k < 3 else "A1") for k in range(4)] + [(1, 1, "Reference", k, "60.35 1" if k == 0 else f"R{k}") for k in range(4)]
    values += [(2, 0, "Invoice No", 0, None), (3, 0, "Inv No", 0, "X"), (3, 1, "Invoice #", 0, "Y"), (4, 0, "Invoice #", 0, "60 35 1")]
    values += [(2, 1, "Inv #", k, "A" if k < 200 else "60 35 1") for k in range(400)]  # only the first 200 count
    frames = spark.createDataFrame(heads, "doc_id long, pos int, header string"), spark.createDataFrame(values, "doc_id long, pos int, header string, row_num int, value string")
    found = {r["doc_id"]: r["header"] for r in extraction.map_columns_a(*frames).where("field = 'invoice_number'").collect()}
    assert found == {1: "Reference", 2: "Inv #", 3: "Inv No", 4: "Invoice #"}
    first = {r["doc_id"]: r["header"] for r in extraction.map_columns_a(frames[0]).where("field = 'invoice_number'").collect()}
    assert first == {1: "Invoice #", 2: "Invoice No", 3: "Inv No", 4: "Invoice #"}
