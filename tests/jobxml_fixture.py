"""Job exports in the documented XML shape, built from short descriptions."""

from __future__ import annotations

from xml.sax.saxutils import escape


def _p(name, value):
    return f'<Property name="{name}">{escape(str(value))}</Property>'


def _sub(**props):
    return "<SubRecord>" + "".join(_p(k, v) for k, v in props.items()) + "</SubRecord>"


def stage(name, kind, pins=(1, 1), props=None, columns=(), derivations=(), record_type=None):
    body = _p("StageType", kind) + _p("InputPins", pins[0]) + _p("OutputPins", pins[1])
    if props:
        body += '<Collection name="Properties">' + "".join(_sub(Name=k, Value=v) for k, v in props.items()) + "</Collection>"
    if columns:
        cols = "".join(_sub(**c) for c in columns)
        body += f'<Collection name="OutputPin"><SubRecord>{_p("Identifier", "OUT")}<Collection name="Column">{cols}</Collection></SubRecord></Collection>'
    if derivations:
        body += '<Collection name="Transformations">' + "".join(
            _sub(Name=n, Expression=e, **({"OutputCol": o} if o else {})) for n, e, o in derivations) + "</Collection>"
    return f'<Record Identifier="{name}" Description="" Type="{record_type or kind}">{body}</Record>'


def link(n, a, b, pin=0):
    return f'<Record Identifier="LINK_{n}" Type="DSLink">{_p("FromStage", a)}{_p("ToStage", b)}{_p("FromPin", pin)}{_p("ToPin", 0)}</Record>'


def job(name, records, kind="JOB_SEQUENCE"):
    head = f'<Record Identifier="{name}" Type="{kind}">{_p("Annotation", "a & b")}</Record>'
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE DSExport>\n<DSExport>\n'
        '<Header CharacterEncoding="CP1252" ExportingTool="x" ExportingToolVersion="1" ServerName="S"/>\n<!-- a comment -->\n'
        f'<Job Identifier="{name}" Description="d" Category="c">{head}{"".join(records)}</Job>\n</DSExport>\n'
    )


def chain(*names):
    return [link(i, a, b) for i, (a, b) in enumerate(zip(names, names[1:]))]


def simple_job():
    """Two sources, join, six derivations, filter, aggregate, target: 7 stages, 6 links."""
    col = dict(Name="CID", SqlType=4, Precision=10, Nullable=0)
    records = [
        stage("ORA_CLIENTS", "PxOracleConnector", (0, 1), {"Connection.DataSource": "CRM", "XMLProperties.SelectStatement": "SELECT CID FROM CLIENTS WHERE ON_HOLD < 1"},
              [col, dict(Name="NAME", SqlType=12, Precision=80)]),
        stage("ORA_DEALS", "PxOracleConnector", (0, 1), {"Connection.DataSource": "CRM"}, [col, dict(Name="WORTH", SqlType=3, Precision=18, Scale=2), dict(Name="ODD", SqlType=77)]),
        stage("JOIN_BOTH", "PxJoin", (2, 1), {"JoinType": "Inner", "JoinKey": "CID"}),
        stage("CALC", "PxTransformer", (1, 1), derivations=[
            ("NET", "WORTH * (1 - CUT / 100)", "NET"), ("TIER", 'If NET > 9 Then "A" Else "B"', "TIER"), ("Y", "Year(DAY)", "Y"),
            ("M", "Month(DAY)", "M"), ("CLEAN", "Upcase(Trim(NAME))", "NAME_CLEAN"), ("BULK", "If QTY >= 100 Then 1 Else 0", None)]),
        stage("KEEP", "PxFilter", props={"FilterCondition": "NET > 0 AND CID IS NOT NULL"}),
        stage("SUM_UP", "PxAggregate", props={"GroupByKeys": "Y,M", "Aggregations": "SUM(NET) AS TOTAL"}),
        stage("BQ_OUT", "PxBigQueryConnector", (1, 0), {"XMLProperties.TableName": "out", "XMLProperties.WriteMode": "APPEND"}),
    ]
    links = [link(0, "ORA_CLIENTS", "JOIN_BOTH"), link(1, "ORA_DEALS", "JOIN_BOTH"),
             *[link(2 + i, a, b) for i, (a, b) in enumerate(zip(["JOIN_BOTH", "CALC", "KEEP", "SUM_UP"], ["CALC", "KEEP", "SUM_UP", "BQ_OUT"]))]]
    return job("SIMPLE_JOB", records + links)


def complex_job():
    """Lookup, left join with exceptions, nine derivations, type 2 target: 9 stages, 8 links."""
    names = ["D1", "D2", "D3", "D4", "D5", "HASH", "S", "E", "C"]
    exprs = ["A - B", "A * P", 'If D1 = 0 Then "X" Else "Y"', "If D1 < L Then 1 Else 0", "If D4 = 1 Then T Else -1",
             "Checksum(ID : Char(A))", "CurrentDate()", "DateFromComponents(9999, 12, 31)", "1"]
    records = [
        stage("SEQ_STOCK", "PxSequentialFile", (0, 1), {"File": "/in/stock_${DS_RUNDATE}.csv", "Delimiter": ","}, [dict(Name="ID", SqlType=12)]),
        stage("DB2_ITEMS", "PxDB2Connector", (0, 1), {"XMLProperties.SelectStatement": "SELECT ID, EFF_END_DATE FROM ITEMS"}, [dict(Name="ID", SqlType=12)]),
        stage("LKP", "PxLookup", (2, 1), {"LookupKey": "SID", "NoMatchHandling": "Continue"}),
        stage("JOIN_LEFT", "PxJoin", (2, 2), {"JoinType": "LeftOuter", "JoinKey": "ID"}),
        stage("CALC", "PxTransformer", (1, 2), derivations=[(n, e, n) for n, e in zip(names, exprs)]),
        stage("EXCEPTION_PEEK", "PxPeekStage"),
        stage("SORT", "PxSortStage", props={"SortKeys": "ID ASC"}),
        stage("BQ_DIM", "PxBigQueryConnector", (1, 0), {"XMLProperties.TableName": "dim", "XMLProperties.WriteMode": "MERGE"}),
        stage("SEQ_EXCEPTIONS", "PxSequentialFile", (1, 0), {"File": "/out/x_${DS_RUNDATE}.csv"}),
    ]
    pairs = [("SEQ_STOCK", "JOIN_LEFT"), ("DB2_ITEMS", "LKP"), ("LKP", "JOIN_LEFT"), ("JOIN_LEFT", "CALC"),
             ("JOIN_LEFT", "EXCEPTION_PEEK"), ("CALC", "SORT"), ("SORT", "BQ_DIM"), ("EXCEPTION_PEEK", "SEQ_EXCEPTIONS")]
    return job("COMPLEX_JOB", records + [link(i, a, b) for i, (a, b) in enumerate(pairs)])
