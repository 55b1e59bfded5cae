"""Frozen schemas and vocabularies of the register graph."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RECORD = _strings("Court_name", "Date_of_article", "Company_name", "Registration_Code", "Registration_year")
REGISTRY_COLUMNS = ("XJustizID", "RegisterCourt", "RegisterType", "State", "PLZ", "ValidUntil", "FutureCode")
REGISTRY = T.StructType([*_strings(*REGISTRY_COLUMNS).fields, T.StructField("Version", T.IntegerType())])
TRIPLE = _strings("s", "p", "o", "o_kind", "o_dt", "o_lang")
IMPRINT = _strings("Company_Name", "Company_Address", "Registration_Court", "Registration_Code", "Registration_year", "status", "message")
RUN_LOG = T.StructType(
    [
        T.StructField("File", T.StringType()),
        T.StructField("Mode", T.StringType()),
        T.StructField("Chunks", T.IntegerType()),
        T.StructField("Time (s)", T.DoubleType()),
        T.StructField("Outcome", T.StringType()),
    ]
)

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: The historical graph writes its terms after a slash, the register graph after a hash; they share none.
EX = "http://example.org/schema/"
EXH = "http://example.org/schema#"
COMPANY = "http://example.org/company/"
COURT = "http://example.org/court/"
REGISTER_COURT = "http://example.org/RegisterCourt/"
XJUSTIZ = "http://example.org/XJustizID/"
STATE = "http://example.org/State/"
REGISTER_TYPE = "http://example.org/RegisterType/"
A = RDF + "type"
#: Text relations of the query language.
QL = "urn:ql:"
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "ex": EX, "comp": COMPANY, "court": COURT, "ql": QL}
