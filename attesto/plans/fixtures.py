"""Small literal inputs for parsers and extractors that have no table among the test data."""

import io
import zipfile

QUOTES = [
    ("q1", "We will invest $1.5 billion and create two hundred jobs, 300 megawatts of power and 2,000 gallons per day"),
    ("q2", "A payment of $2 million a year to the county; 50 permanent full-time positions"),
    ("q3", "Ordinance 2024-15 passed 5 to 2 at 7:30 pm on agenda item 12"),
    ("q4", "five hundred thousand gallons were stored, 1.2 GW planned, 12 million dollars"),
    ("q5", None),
]
ANSWERS = [
    ("a1", "The county approved it [1]. Acme Inc. objected. U.S. rules apply! [2][3] Done"),
    ("a2", "费用为五百万。获批准。"),
    ("a3", "It cost 3.5 million. Yes?[1] No"),
    ("a4", ""),
]
JUDGED = [("v1", 'Sure: {"verdict": "supported", "why": "a } b"} trailing'), ("v2", "no json"), ("v3", '{"verdict": "CONTRADICTED", "evidence_chunk": 2}'), ("v4", '{"verdict": 3}'), ("v5", None), ("v6", '{oops} {"verdict": "supported"}')]
VTT = "WEBVTT\nKind: captions\n\n00:00:01.000 --> 00:00:03.000\ngood <c>evening</c>\n\n00:00:03.000 --> 00:00:05.000\ngood evening everyone\n\n00:00:05.000 --> 00:00:06.000\neveryone\n\n01:20.000 --> 01:22.000\nitem &amp; motion\n"
VIDEOS = [("v1", "20240102", VTT, "Alpha County, VA"), ("v2", "20240103", "no header", "Beta"), ("v3", "20240104", "WEBVTT\n\n00:01 --> bad\nx\n", "Gamma")]
_LONG = "Risk text of this section goes on and on. " * 8
FILING = (
    "<html><body><p><b>Item 1. Business</b></p><p>We build.</p><p><a href='#x'><b>Item 1A. Risk Factors</b></a></p>"
    f"<p style='font-weight:700'>Item 1A. Risk Factors</p><p>{_LONG}</p><p><b>Item 7.</b> not bold</p><p><b>Item 7. Discussion</b></p><p>{_LONG}</p><p><b>Item 8. Statements</b></p></body></html>"
)
FILINGS = [("AAA", "0000000001-24-000001", "10-K", "2024-02-01", FILING), ("AAA", "0000000001-24-000002", "8-K", "2024-03-01", "<div>Item 2.02 Results</div><p>Fine.</p>"), ("AAA", "0000000001-24-000003", "4", "2024-03-02", "<p>x</p>")]
CALLS = [
    ("AAA", 1, 2024, "2024-04-30 17:00", "Operator: Welcome.\nplease hold\nJane Q. Doe: hi\nJane Doe: Hello: all\nJane Doe: again\n\nOperator: Bye"),
    ("BBB", 2, 2024, "2024-07-30", "no speakers here\nat all"),
]
FORM4 = """<?xml version="1.0"?><ownershipDocument><issuer><issuerCik>0000123</issuerCik></issuer><reportingOwner><reportingOwnerId><rptOwnerName>DOE JANE</rptOwnerName></reportingOwnerId>
<reportingOwnerRelationship><isOfficer>1</isOfficer><isDirector>false</isDirector><officerTitle>CFO</officerTitle></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>
<nonDerivativeTransaction><transactionDate><value>2024-05-01</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding><transactionAmounts>
<transactionShares><value>100</value></transactionShares><transactionPricePerShare><value>10.5</value></transactionPricePerShare></transactionAmounts><postTransactionAmounts>
<sharesOwnedFollowingTransaction><value>900</value></sharesOwnedFollowingTransaction></postTransactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""
XML = [("AAA", "acc1", "url1", FORM4), ("AAA", "acc2", "url2", "<!DOCTYPE x><a/>"), ("AAA", "acc3", "url3", "<broken")]
ATOM = (
    '<feed xmlns="http://www.w3.org/2005/Atom"><entry><content type="text/xml"><accession-number>0000000001-24-000009</accession-number><filing-type>8-K</filing-type>'
    "<filing-date>2024-06-01</filing-date><filing-href>http://x/1</filing-href></content></entry><entry><content><filing-type>8-K</filing-type></content></entry>"
    "<entry><content><accession-number>0000000001-24-000001</accession-number><filing-type>10-K</filing-type><filing-date>2024-02-01</filing-date></content></entry></feed>"
)
FTS = '{"hits":{"hits":[{"_id":"0000000001-24-000011:a.htm","_source":{"root_forms":["8-K"],"ciks":["1"],"display_names":["Acme Corp (ACM, ACMW) (CIK 0000000001)","Other (CIK 0000000002)"],"file_date":"2024-06-02"}}]}}'
MISO = '[{"projectNumber":"J1","county":"Polk","state":"IA","summerNetMW":"1,200.5","fuelType":"Wind","applicationStatus":"Active","queueDate":"2023-01-05T00:00:00Z","withdrawnDate":null},{"projectNumber":null},{"projectNumber":"J2","county":"Linn","state":"IA","summerNetMW":"x","fuelType":"Solar","applicationStatus":"Withdrawn","queueDate":"3/4/2022"}]'
SPP = "Updated today\nGeneration Interconnection Number, Nearest Town or County ,State,MAX Summer MW,Generation Type,Fuel Type,Status,Request Received,Date Withdrawn\nG1,Tulsa,OK,100,,Gas,DONE,1/2/2020,\n,none,OK,1,,,,,\nG2,Ellis,KS,\"2,000\",Wind,,IA,2021-05-06T10:00,5/5/2022\n"
PERMITS = '{"Results":{"Facilities":[{"SourceID":"P1","CWPName":" Plant ","CWPCounty":"Polk","CWPState":"IA","CWPPermitStatusDesc":"Effective"},{"SourceID":"","CWPName":"none"},{"SourceID":"P1","CWPName":"again","CWPCounty":"Linn","CWPState":"IA"}]}}'
MATTERS = [("mesa", "Mesa, AZ", '{"MatterId":7,"MatterIntroDate":"2024-01-05T00:00:00","MatterFile":"F-1","MatterName":"","MatterTitle":"Rezoning"}'), ("mesa", "Mesa, AZ", '{"MatterId":8,"MatterIntroDate":"bad","MatterTitle":"x"}'), ("mesa", "Mesa, AZ", '{"MatterIntroDate":"2024-01-05","MatterTitle":"x"}')]
STOOQ = "Date,Open,High,Low,Close,Volume\n2024-01-03,1,1,1,11.5,9\n2024-01-02,1,1,1,10,9\nbad,1,1,1,1,1\n2024-01-04,1,1,1,x,1\n2024-01-05,1\n"
FMP_PRICES = '{"symbol":"A","historical":[{"date":"2024-01-03","close":2},{"date":"2024-01-02","close":1.5},{"date":"2024-01-04","close":true},{"date":"2024-01-05","close":"3"},{"date":"x","close":1}]}'
CHART = '{"chart":{"result":[{"timestamp":[1704205800,1704292200,1704378600],"indicators":{"quote":[{"close":[1.0,null,3.0]}]}}]}}'
STREAMS = [("Alpha", "abc|is_live|Board | Session"), ("Alpha", "def|is_upcoming|Lo-fi music"), ("Alpha", "ghi|was_live|Council"), ("Alpha", "broken")]
EVENT_DOCS = [("e1", "Header\n  Item 2.02 Results\nItem 9.01 Exhibits\nitem 2.02 again\nsee Item 8.01 inline", "filing", "AAA", "2024-03-01", "l1"), ("e2", "no items", "filing", "BBB", "2024-03-02", "l2"), ("e3", "Item 1.01 x", "earnings_call", "CCC", "2024-03-03", "l3")]
SHELL_DOCS = [
    ("s1", "Project Falcon Report and Jade River Holdings LLC spoke. The Blue Partners came. Project Timeline next.", "county_meeting", "Alpha", "2024-01-01", "l1"),
    ("s2", "Again Project Falcon, with Acme Corp.", "county_meeting", "Beta", "2024-02-01", "l2"),
    ("s3", "Project Falcon in a filing", "filing", None, "2024-03-01", "l3"),
]
OUTCOME_DOCS = [
    ("d1", "they brought 300 megawatts of power online", "Alpha", "2024-03-01"), ("d2", "Acme Corp. was there", "Alpha", "2024-04-01"),
    ("d3", "we promise new water treatment and a plant nearby", "Alpha", "2024-05-01"), ("d4", "nothing of note", "Alpha", "2023-01-01"), ("d5", "nothing at all", "Beta", "2024-12-01"), ("d6", "soon", "Gamma", "2024-02-10"),
]
PROMISES = [
    ("p1", "Alpha", "2024-01-01", "we bring 300 MW and new water treatment plant"), ("p2", "Beta", "2024-01-01", "jobs for everyone in town"),
    ("p3", "Gamma", "2024-02-01", "something nice"), ("p4", "Nowhere", "2024-02-01", "x"),
]
LETTERS = [("l1", 'As said, "nothing at all" [d5] and "never said" [d1] and "soon" [zz]')]


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A minimal workbook with inline strings; tuples are days."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = ""
                for c, v in enumerate(row):
                    ref = f"{chr(65 + c)}{r}"
                    if isinstance(v, tuple):
                        cells += f'<c r="{ref}" s="1"><v>{v[0]}</v></c>'
                    elif isinstance(v, str):
                        cells += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                    elif v is not None:
                        cells += f'<c r="{ref}"><v>{v}</v></c>'
                body += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


SHEETS = {
    "Project Details - Large Gen": [["title"], [], ["INR", "County", "Capacity (MW)", "Fuel", "Projected COD", "Air Permit"], ["I1", "Polk", 120.5, "GAS", (45292,), "yes"], [None, "none"]],
    "Grid GenerationQueue": [["Queue Position", "County", "State", "Net MWs to Grid", "MW-1", "Application Status", "Fuel-1", "Queue Date"], ["7", "Kern", "CA", None, "1,000", "Withdrawn", "Sun", (45293,)]],
    "Planned": [["x"], ["Entity Name", "Plant Name", "Plant State", "County", "Nameplate Capacity (MW)", "Technology", "Sector", "Planned Operation Month", "Planned Operation Year"], ["E", "P", "TX", "Polk", 5, "Wind", "IPP", 3, 2026], ["E2", "P2", "TX", "Polk", 5, "Wind", "IPP", None, 2026]],
}
