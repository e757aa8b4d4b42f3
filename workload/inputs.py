"""Messages made from the driver's tables.

Leaf expressions are SQL text that Spark and the checking engine read alike, so
one listing serves both the records built here and the rows expected of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan.functions.text import quoted
from fieldscan.session import configure

_K = "cast(c_custkey as bigint)"
_PHONE = f"'+1-' || cast(200 + {_K} % 700 as string) || '-555-' || lpad(cast({_K} % 10000 as string), 4, '0')"
_ACCOUNT = f"lpad(cast(({_K} * 7907 + 1000000) % 1000000000000 as string), 12, '0')"

CUSTOMER_LEAVES = {
    "customer_id": f"'CUST-' || lpad(cast({_K} as string), 6, '0')",
    "customer.full_name": "c_name",
    "customer.emailAddress": f"'user' || cast({_K} as string) || '@mail' || cast({_K} % 7 as string) || '.example.com'",
    "customer.phone_number": _PHONE,
    "customer.SSNValue": f"cast(100 + {_K} % 800 as string) || '-' || cast(10 + {_K} % 90 as string) || '-' || cast(1000 + {_K} % 9000 as string)",
    "customer.lastIP": f"'10.' || cast({_K} % 256 as string) || '.' || cast(({_K} * 7) % 256 as string) || '.' || cast(({_K} * 13) % 256 as string)",
    "payment.cards[0].number": f"'4' || lpad(cast(({_K} * 7919 + 123457) % 1000000000000000 as string), 15, '0')",
    "payment.cards[0].holder": "c_name",
    "payment.cards[1].number": f"'5500-0000-' || lpad(cast({_K} % 10000 as string), 4, '0') || '-' || lpad(cast(({_K} * 31) % 10000 as string), 4, '0')",
    "payment.cards[1].holder": "c_name",
    "payment.iban": f"'GB' || cast(10 + {_K} % 90 as string) || 'NWBK' || lpad(cast(({_K} * 104729) % 100000000000000 as string), 14, '0')",
    "payment.ref": f"case {_K} % 4 when 0 then 'SWIFT: DEUTDEDB' when 1 then 'BIC code is CHASUS33' when 2 then '0x' || substr(md5(cast({_K} as string)), 1, 32) || '71c7656e' else 'no reference' end",
    "account.accountNumber": _ACCOUNT,
    "account.routing": f"lpad(cast(({_K} * 999983) % 1000000000 as string), 9, '0')",
    "medical.provider_npi": f"cast(1000000000 + ({_K} * 7717) % 1000000000 as string)",
    "medical.code": f"'AB' || lpad(cast(({_K} * 37) % 10000000 as string), 7, '0')",
    "medical.diagnosis": f"case {_K} % 4 when 0 then 'Type 2 Diabetes' when 1 then 'Hypertension' when 2 then 'Asthma' else 'none' end",
    "auth.password": f"'Hunter' || cast({_K} % 98 as string) || '!'",
    "auth.value": f"case {_K} % 3 when 0 then 'AKIA' || upper(substr(md5(cast({_K} as string)), 1, 16)) when 1 then 'eyJ' || md5(cast({_K} as string)) || '.e30.' || md5(c_name) else 'postgresql://admin:s3cr3t@db' || cast({_K} % 9 as string) || '.internal:5432/prod' end",
    "guardian.child_id": f"case when {_K} % 5 = 0 then 'MINOR-' || cast({_K} as string) end",
    "nation": "cast(c_nationkey as string)",
    "active": f"case when {_K} % 2 = 0 then 'true' else 'false' end",
    "notes": f"'Wire from checking account ' || {_ACCOUNT} || ' — call mobile ' || {_PHONE} || '. Café owner named Müller on Metformin 500mg.'",
}

# kind: table, message id, topic, key, event time, leaves
KINDS = {
    "documents": ("documents", "cast(doc_id as string)", "source", "lang", None,
                  {"doc_id": "cast(doc_id as string)", "lang": "lang", "comment": "text"}),
    "pages": ("pages", "cast(page_id as string)", "'pages'", "url", None, {"url": "url", "body": "html"}),
    "conversations": ("conversations", "cast(conv_id as string) || '/' || cast(turn as string)", "role", "cast(conv_id as string)", None,
                      {"conv_id": "cast(conv_id as string)", "turn": "cast(turn as string)", "role": "role", "message": "text"}),
    "customers": ("customer", "cast(c_custkey as string)", "c_mktsegment", "c_name", None, CUSTOMER_LEAVES),
    "events": ("events", "cast(event_id as string)", "event_type", "cast(user_id as string)", "ts",
               {"event_id": "cast(event_id as string)", "user_name": "'user_' || cast(user_id as string)",
                "client.ip": "'10.0.' || cast(user_id % 256 as string) || '.' || cast(event_id % 256 as string)",
                "event_type": "event_type"}),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


SMALL_BYTES = 256 << 20
# What a task is dealt of a file: a customer of 20 bytes there becomes twenty fields of some hundred bytes.
TASK_BYTES = 1 << 20


def parts_of(df: DataFrame) -> int:
    """How many tasks a table is dealt over: the cores, and more as it grows. No job runs to find out."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """The test tables are single small files; they are dealt over the cores.

    Only what the planner knows to be small is moved; no job runs to find out.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(parts_of(df)) if size <= SMALL_BYTES else df


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, dealt over the cores: a file's row groups are too few tasks."""
    there = table(spark, sf, name)
    return spark.readStream.schema(there.schema).parquet(f"{sf}/{name}.parquet*").repartition(parts_of(there))


def nested_sql(leaves: dict[str, str]) -> str:
    """SQL that nests leaf expressions by their paths (``a.b[0].c``)."""
    tree: dict = {}
    for path, sql in leaves.items():
        node = tree
        parts = path.replace("[", ".[").split(".")
        for part in parts[:-1]:
            node = node.setdefault(part, {})
        node[parts[-1]] = sql

    def render(node) -> str:
        if isinstance(node, str):
            return node
        if all(k.startswith("[") for k in node):
            return "array(" + ", ".join(render(v) for v in node.values()) + ")"
        return "named_struct(" + ", ".join(f"{quoted(k)}, {render(v)}" for k, v in node.items()) + ")"

    return render(tree)


def records(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """A kind's messages with the record as a typed struct ``rec``."""
    configure(spark)
    name, msg_id, topic, key, time, leaves = KINDS[kind]
    return spread(table(spark, sf, name)).select(
        F.expr(msg_id).alias("msg_id"),
        F.expr(topic).alias("topic"),
        F.expr(key).alias("key"),
        (F.col(time).cast("timestamp") if time else F.lit(None).cast("timestamp")).alias("event_time"),
        F.expr(nested_sql(leaves)).alias("rec"),
    )


def messages(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """A kind's messages with the record as JSON text ``value``."""
    return records(spark, sf, kind).select("msg_id", "topic", "key", "event_time", F.to_json("rec").alias("value"))


def order_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer and the list of their lines, as JSON text."""
    configure(spark)
    lines = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("l_quantity"), "l_shipdate", "l_tax", "l_extendedprice"
                    )
                )
            ).alias("ls")
        )
        .select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.transform("ls", lambda x: F.struct(x["l_linenumber"].alias("n"), x["l_partkey"].alias("part"), x["l_quantity"].alias("qty"))).alias("lines"),
        )
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    body = F.struct(
        "o_orderkey", F.col("o_orderpriority").alias("priority"),
        F.struct(F.col("o_custkey").alias("id"), F.col("c_name").alias("name")).alias("customer"), "lines",
    )
    return (
        orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left")
        .join(lines, "o_orderkey", "left")
        .select(F.col("o_orderkey").cast("string").alias("msg_id"), F.lit("orders").alias("topic"), F.to_json(body).alias("value"))
    )


# Registry of the customer topics: which field paths each version lists.
# BUILDING has no schema, AUTOMOBILE a JSON one; FURNITURE's second version lost
# two fields and carries two tags already.
TAGGED = {"customer.emailAddress": ["PII"], "payment.iban": ["PCI"]}
LOST = ("auth.password", "medical.code")


def avro_text(paths: list[str], tags: dict[str, list[str]]) -> str:
    """Avro schema text with the given leaf paths; list items are records."""
    import json

    def node(prefix: str, names: list[str]):
        heads = list(dict.fromkeys(n.split(".")[0] for n in names))
        fields = []
        for head in heads:
            rest = [n[len(head) + 1:] for n in names if n.startswith(head + ".")]
            bare = head.split("[")[0]
            full = f"{prefix}.{bare}".lstrip(".")
            kind = node(full, rest) if rest else "string"
            if "[" in head and any(f["name"] == bare for f in fields):
                continue
            kind = {"type": "array", "items": kind} if "[" in head else ["null", kind]
            field = {"name": bare, "type": kind}
            if full in tags:
                field["x:tags"] = tags[full]
            fields.append(field)
        return {"type": "record", "name": (prefix.replace(".", "_") or "Customer"), "fields": fields}

    return json.dumps({**node("", paths), "namespace": "shop"})


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """schemas(subject, version, id, schema_type, schema) of the customer topics."""
    full = avro_text(list(CUSTOMER_LEAVES), {})
    lost = avro_text([p for p in CUSTOMER_LEAVES if p not in LOST], TAGGED)
    topics = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("k"))
    versions = F.array(
        F.struct(F.lit(1).alias("version"), F.lit(full).alias("schema")),
        F.struct(F.lit(2).alias("version"), F.when(F.col("c_mktsegment") == "FURNITURE", lost).otherwise(full).alias("schema")),
    )
    return (
        topics.where(F.col("c_mktsegment") != "BUILDING")
        .select("c_mktsegment", F.explode(versions).alias("v"))
        .select(
            F.concat("c_mktsegment", F.lit("-value")).alias("subject"),
            "v.version",
            (F.length("c_mktsegment") * 10 + F.col("v.version")).cast("int").alias("id"),
            F.when(F.col("c_mktsegment") == "AUTOMOBILE", "JSON").otherwise("AVRO").alias("schema_type"),
            "v.schema",
        )
    )
