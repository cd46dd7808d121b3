import json
import zipfile

import pytest
from pyspark.sql import functions as F

from netfusion.functions import parsing
from netfusion.operators import ingest
from netfusion.sources import detect, files
from netfusion.sources.schemas import COLUMNS


def one(spark, rows, expression):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(expression(F.col("x"))).collect()]


def test_amounts(spark):
    rows = ["₹45,000.00", "$12,500", "45000/-", "2.5L", "3.2 Cr", "1.5k", "2.3L", "2 lakhs", "Rs. 70", "none", "", None, "-", "abc", "1 million", "-5"]
    assert one(spark, rows, parsing.parse_amount) == [45000, 12500, 45000, 250000, 32000000, 1500, 230000, 200000, 70, 0, 0, 0, 0, 0, 1000000, 5]


def test_dates_and_days(spark):
    rows = ["2026-01-05 14:30:00", "05/01/2026 14:30:00", "5-1-2026", "1767623400", "1767623400000", "46027", "5 Jan 2026", "13/25/2026", "NA", None, "2026-01-05T14:30:00.123"]
    got = one(spark, rows, parsing.parse_date)
    assert got == ["2026-01-05 14:30:00", "2026-01-05 14:30:00", "2026-01-05 00:00:00", "2026-01-05 14:30:00", "2026-01-05 14:30:00", "2026-01-05 00:00:00", "2026-01-05 00:00:00", "13/25/2026", None, None, "2026-01-05 14:30:00"]
    assert one(spark, ["58", "2026-01-01", "2026-03-01", "2025-12-31", "0", "x"], parsing.to_day) == [58, 1, 60, None, None, None]


def test_phones_and_durations(spark):
    assert one(spark, ["+91 98765-43210", "70000 12345", "91234", None], parsing.clean_phone) == ["9876543210", "7000012345", "91234", ""]
    assert one(spark, ["90", "5m", "1.5 h", "30 secs", "x", None], parsing.clean_duration) == [90, 300, 5400, 30, 0, 0]


def test_detection_and_mapping():
    assert detect.clean_header(" Caller-No./x ") == "caller_no_x"
    m = detect.suggest_mapping(["call_id", "caller", "receiver", "day", "duration_sec", "type"], "cdrs")
    assert detect.validate_mapping(m, "cdrs") == (True, []) and m["call_id"] == "call_id" and m["caller_phone"] == "caller" and m["callee_phone"] == "receiver" and m["call_type"] == "type"
    m = detect.suggest_mapping(["Remitter", "Beneficary Account", "Txn Amount"], "transactions")
    assert m["amount_inr"] == "Txn Amount" and m["receiver_account"] == "Beneficary Account"
    assert detect.validate_mapping({"amount_inr": "x"}, "transactions") == (False, ["sender_id", "receiver_id"])
    assert detect.detect_type(["caller_phone", "callee_phone", "duration"])[0] == "cdrs" and detect.detect_type(["x"])[0] == "unknown"
    with pytest.raises(ValueError):
        detect.review_mapping(["a"], "firs", {"narrative": "b"})


def test_sniffing():
    assert [detect.sniff_delimiter(s) for s in ("a;b\n1;2\n", "a\tb\n1\t2\n", "a|b\n1|2", "x")] == [";", "\t", "|", ","]
    assert detect.decode("é".encode("latin-1")) == "é" and detect.decode(b"\xef\xbb\xbfx") == "x"
    assert detect.detect_format("a.TSV") == "txt" and detect.detect_format("noext", b'{"a":1}') == "json"
    assert detect.is_table("a,b\n1,2") and not detect.is_table("A man whom nobody had ever seen, tall, came\nin, later") and detect.is_table("x", ".tsv")


def test_fixed_csv_and_quarantine(spark, tmp_path):
    head = ",".join(COLUMNS["transactions"])
    (tmp_path / "transactions.csv").write_text(f"{head},ground_truth_flag\nT1,A,a,,B,b,,100,2026-01-01,1,Cash,x\nT2,A,a,,B,b,,200,2026-01-01,,Cash,x\n")
    rows, bad = files.read_fixed_csv(spark, str(tmp_path / "transactions.csv"), "transactions")
    assert "ground_truth_flag" not in rows.columns and [(r.txn_id, r.amount_inr, r.day, r._quarantine_confidence) for r in rows.collect()] == [("T1", 100, 1, None), ("T2", 200, None, 0.3)]
    assert [tuple(r) for r in bad.collect()] == [(3, "transactions.csv", "Missing day", 0.3)]
    (tmp_path / "firs.csv").write_text("a,b\n1,2\n")
    (tmp_path / "people_directory.json").write_text(json.dumps({"network_people": [{"id": "A1", "name": "x"}], "noise_people": [{"id": "N1"}], "other": 1}))
    data, bad = files.load_all(spark, str(tmp_path))
    assert {k: v.count() for k, v in data.items()}["people_directory"] == 2 and data["firs"].count() == 0
    reasons = [r.reason for r in bad.collect()]
    assert reasons.count("File not found") == 5 and any(r.startswith("Header mismatch") for r in reasons)


def test_flexible_tables_json_documents(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿Name ;Note\nx;"two\nlines"\n;\ny\n')
    rows = files.read_table(spark, str(tmp_path / "t.csv"))
    assert rows.columns == ["Name", "Note"] and [tuple(r) for r in rows.collect()] == [("x", "two\nlines"), ("y", "")]
    (tmp_path / "r.json").write_text(json.dumps({"records": [{"a": 1}, {"a": 2, "b": 3}]}))
    assert files.read_json_records(spark, str(tmp_path / "r.json")).count() == 2
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("FIR No. 12/2026 of 05/01/2026. Accused: Ravi Kumar fled.\n\nSecond paragraph.")
    with zipfile.ZipFile(tmp_path / "docs" / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>Only </w:t></w:r><w:r><w:t>one.</w:t></w:r></w:p></w:document>')
    (tmp_path / "docs" / "c.pdf").write_bytes(b"%PDF")
    rows, bad = files.read_documents(spark, str(tmp_path / "docs"))
    got = {(r.source, r.fir_id, r.date, r.accused_name, r.narrative) for r in rows.collect()}
    assert ("a.txt", "12/2026", "05/01/2026", "Ravi Kumar", "FIR No. 12/2026 of 05/01/2026. Accused: Ravi Kumar fled.") in got
    assert ("a.txt", "DOC-0002", None, None, "Second paragraph.") in got and ("b.docx", "DOC-0001", None, None, "Only one.") in got
    assert [r.source_file for r in bad.collect()] == ["c.pdf"]


def test_pdf_text():
    import zlib

    page = rb"BT /F1 9 Tf (One \(two\) \101) Tj 0 -12 Td [(sp) -250 (lit)] TJ T* <48 69> Tj ET"
    plain = b"%PDF-1.4\n1 0 obj <<>>\nstream\n" + page + b"\nendstream\n"
    packed = b"2 0 obj <</Filter /FlateDecode>>\nstream\r\n" + zlib.compress(b"q BT (second page) Tj ET Q") + b"\r\nendstream"
    assert files.pdf_text(plain + packed) == "One (two) A\nsplit\nHi\nsecond page" and files.pdf_text(b"%PDF") == ""


@pytest.mark.parametrize(
    ("dataset", "target", "names"),
    [
        ("cdrs", "caller_phone", "Caller Source_Phone A_Num calling-no originating_no A_Number source_msisdn calling_party from_number caller_mobile phone1 msisdn source"),
        ("cdrs", "callee_phone", "Receiver to_phone B_Num called_no terminating_no dest_msisdn called_party callee_mobile phone2 destination"),
        ("cdrs", "cell_tower_location", "tower location tower_location cell_id cell_site tower_id site_id lac_cell CGI tower_address coverage_area"),
        ("cdrs", "timestamp", "event_time call_time DateTime call_datetime start_time call_date date cdr_date"),
        ("transactions", "sender_account", "sender_acc from_account payer_account remitter_account debit_acc debit_account source_account from_acc debited_account"),
        ("transactions", "receiver_account", "receiver_acc to_account payee_account beneficiary_account credit_acc credit_account destination_account to_acc credited_account"),
        ("transactions", "amount_inr", "amount value sum inr price txn_val txn_value txn_amount debit_inr credit_inr debit_amt credit_amt transfer_amount particulars narration transaction_value rs rupees amt"),
        ("transactions", "txn_id", "transaction_id id trans_id txn_no ref_no utr reference reference_no transaction_ref"),
        ("firs", "narrative", "description details text story incident report facts brief_facts fact_summary allegation allegations incident_summary incident_details complaint complaint_details crime_details case_details fir_details summary remarks narration particulars content activity_notes"),
        ("firs", "fir_id", "case_id id report_id fir_no fir_number case_no case_number crime_no complaint_no"),
        ("firs", "accused_name", "accused accused_person suspect_name suspect"),
        ("social_posts", "handle", "username user author_handle author screen_name profile account_handle"),
        ("criminal_history", "prior_offences", "offences offenses criminal_record history previous_cases past_offences convictions antecedents criminal_history prior_cases cases category"),
        ("intelligence_reports", "mentioned_entity_ids", "mentioned_entities entities mentioned_ids entity_ids linked_ids"),
        ("surveillance_reports", "activity_notes", "notes observations activity remarks details watch_log field_notes surveillance_notes text description summary report narrative"),
        ("people_directory", "account", "account_number acc_no bank_account ac_no"),
    ],
)
def test_header_names(dataset, target, names):
    for name in names.split():
        assert detect.suggest_mapping([name], dataset)[target] == name, name


def test_excel(spark, tmp_path):
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S1" r:id="r1"/><sheet name="S2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>a</t></si><si><t>b</t></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{m}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2"><v>7</v></c></row><row></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{m}"><sheetData><row><c r="A1" t="inlineStr"><is><t>c</t></is></c></row><row><c r="A2"><v>9</v></c></row></sheetData></worksheet>')
    rows = files.read_excel(spark, str(tmp_path / "b.xlsx"))
    assert sorted(tuple(r) for r in rows.select("a", "b", "c", "_sheet").collect()) == [("", "", "9", "S2"), ("", "7", "", "S1")]


def test_zip(tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name in ("x/a.csv", "ground_truth/b.csv", "../c.csv", "d.exe", "e.json"):
            z.writestr(name, "1")
    (tmp_path / "out").mkdir()
    assert [p.rsplit("/", 1)[1] for p in files.expand_zip(str(tmp_path / "z.zip"), str(tmp_path / "out"))] == ["e.json", "x_a.csv"]


def test_normalise_and_split(spark):
    raw = spark.createDataFrame([("", "7000012345", "2.5L"), ("A", "", ""), ("", "", "x")], "sender_name string, receiver_account string, amount string")
    rows = ingest.normalize(raw, "transactions")
    assert [(r.txn_id, r.sender_id, r.receiver_account, r.amount_inr, r.txn_type) for r in rows.collect()] == [("GEN-TXN00001", "UNK0", "7000012345", 250000, "Bank Transfer"), ("GEN-TXN00002", "A", "", 0, "Bank Transfer"), ("GEN-TXN00003", "UNK2", "", 0, "Bank Transfer")]
    notes = spark.createDataFrame([("a long story", ""), ("x", ""), ("", "IPC 1")], "narrative string, ipc_sections string")
    good, bad = ingest.split_quarantine(ingest.normalize(notes, "firs"), "firs", "f.csv")
    assert good.count() == 2 and [(r.row_no, r.reason) for r in bad.collect()] == [(3, "Missing/invalid required field(s): narrative")]
    for name in COLUMNS:
        assert ingest.normalize(notes, name).count() == 3


def test_bootstrap(spark):
    people = spark.createDataFrame([("A1", "1", "X"), ("AUTO-001", "9", "")], "id string, phone string, account string")
    calls = spark.createDataFrame([("B1", "bee", "2", "A1", "x", "1"), ("UNK3", "", "3", "B1", "bee", "2")], "caller_id string, caller_name string, caller_phone string, callee_id string, callee_name string, callee_phone string")
    txns = spark.createDataFrame([("B1", "bee", "Y", "C1", "", "Z")], "sender_id string, sender_name string, sender_account string, receiver_id string, receiver_name string, receiver_account string")
    got = {r.id: (r.name, r.phone, r.account) for r in ingest.bootstrap(people, calls, txns).collect()}
    assert got == {"B1": ("bee", "2", "Y"), "C1": ("C1", "", "Z"), "AUTO-002": ("AUTO-002", "3", "")}
