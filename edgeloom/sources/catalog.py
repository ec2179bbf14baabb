"""Nested drug catalogue (XML) flattened to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k.replace("__", "-"), v) for k, v in fields.items()])


_XREF = _struct(external__identifier=T.ArrayType(_struct(resource=_S, identifier=_S)))
_POLY = _struct(_id=_S, external__identifiers=_XREF)
_PART = T.ArrayType(_struct(polypeptide=T.ArrayType(_POLY)))

# Element names of the catalogue format.
CATALOG_SCHEMA = _struct(
    drugbank__id=T.ArrayType(_struct(_VALUE=_S, _primary=T.BooleanType())),
    name=_S,
    products=_struct(product=T.ArrayType(_struct(name=_S))),
    drug__interactions=_struct(drug__interaction=T.ArrayType(T.StructType([T.StructField("drugbank-id", _S)]))),
    calculated__properties=_struct(property=T.ArrayType(_struct(kind=_S, value=_S))),
    external__identifiers=_XREF,
    targets=_struct(target=_PART),
    enzymes=_struct(enzyme=_PART),
    carriers=_struct(carrier=_PART),
    transporters=_struct(transporter=_PART),
)
ROLES = {"target": "targets", "enzyme": "enzymes", "carrier": "carriers", "transporter": "transporters"}


def read_catalog(spark: SparkSession, path) -> DataFrame:
    """One row per drug record with its primary id as ``drug``."""
    df = spark.read.format("xml").option("rowTag", "drug").schema(CATALOG_SCHEMA).load(path)
    ids = F.col("drugbank-id")
    primary = F.filter(ids, lambda x: F.coalesce(x["_primary"], F.lit(False)))
    first = F.coalesce(F.try_element_at(primary, F.lit(1)), F.try_element_at(ids, F.lit(1)))
    df = df.withColumn("drug", first["_VALUE"])
    # Inner tags of the same name (interaction partners) carry no record of their own.
    return df.filter(F.col("drug").isNotNull() & F.col("name").isNotNull())


def catalog_edges(catalog: DataFrame, roles=tuple(ROLES), resource: str = "UniProtKB") -> DataFrame:
    """Distinct (src drug, dst protein, role). Parts without an id in the resource give no row."""
    out = None
    for role in roles:
        part = catalog.select("drug", F.explode(F.col(ROLES[role])[role]).alias("p"))
        poly = part.select("drug", F.explode("p.polypeptide").alias("y"))
        xref = poly.select("drug", F.explode(F.col("y")["external-identifiers"]["external-identifier"]).alias("x"))
        rows = xref.filter(F.col("x.resource") == resource).select(F.col("drug").alias("src"), F.col("x.identifier").alias("dst"), F.lit(role).alias("role"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


# Resource names of the external identifiers.
EXTERNAL = {"kegg_drug": "KEGG Drug", "kegg_compound": "KEGG Compound", "pubchem_compound": "PubChem Compound", "pubchem_substance": "PubChem Substance"}


def catalog_external_ids(catalog: DataFrame) -> DataFrame:
    """One column per external vocabulary, with the first identifier of each; ``pubchem`` is the compound, else the substance."""
    listed = F.col("external-identifiers")["external-identifier"]
    first = lambda r: F.try_element_at(F.filter(listed, lambda x: x["resource"] == r), F.lit(1))["identifier"]
    picks = [first(r).alias(n) for n, r in EXTERNAL.items()]
    return catalog.select("drug", *picks).withColumn("pubchem", F.coalesce("pubchem_compound", "pubchem_substance"))


def catalog_names(catalog: DataFrame) -> DataFrame:
    """Map (k name, v drug, ord): generic names in lower case, product names in upper case.

    The record later in the catalogue wins (by drug id); reduce with ``keep='last'``.
    """
    generic = catalog.select(F.lower("name").alias("k"), F.col("drug").alias("v"))
    product = catalog.select(F.explode(F.col("products")["product"]).alias("p"), "drug")
    product = product.select(F.upper("p.name").alias("k"), F.col("drug").alias("v"))
    return generic.unionByName(product).filter(F.col("k").isNotNull()).distinct().withColumn("ord", F.col("v"))


def catalog_property(catalog: DataFrame, kind: str) -> DataFrame:
    """(drug, value) of the first calculated property of a kind."""
    hits = F.filter(F.col("calculated-properties")["property"], lambda p: p["kind"] == kind)
    return catalog.select("drug", F.try_element_at(hits, F.lit(1))["value"].alias("value")).filter(F.col("value").isNotNull())


def catalog_ddi(catalog: DataFrame) -> DataFrame:
    """Distinct unordered drug pairs that interact."""
    x = catalog.select("drug", F.explode(F.col("drug-interactions")["drug-interaction"]).alias("i"))
    x = x.select("drug", F.col("i")["drugbank-id"].alias("other")).filter(F.col("other").isNotNull())
    return x.select(F.least("drug", "other").alias("src"), F.greatest("drug", "other").alias("dst")).distinct()
