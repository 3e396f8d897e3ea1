"""Discovery (1xx): what each instance is."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fold
from ..operators import RowRule, attributes_wide, rule_scan, string_list
from ..operators.versions import VERSION_NAMES
from .availability import endpoint_rights
from .facts import Facts, raw, text_for, union

# Attribute names by check id: fixed values.
NAMES = {
    100: "Capture date", 101: "Server Name", 102: "Instance Name", 103: "Instance Version", 104: "Instance Edition", 105: "Instance Build",
    106: "Error Log Location", 107: "Default Data File Path", 108: "Default Log File Path", 109: "Default Backup File Path",
    110: "Trace Flag In Use", 111: "Communication Protocol", 112: "Last Restart Time", 113: "CPU Configuration",
    114: "Server Memory in MB", 115: "Operating System", 116: "SQL Server Service Account", 117: "SQL Agent Service Account",
    118: "Instance count", 119: "IP Address", 120: "Server Type", 198: "Can connect to Endpoint", 199: "Is sysadmin",
}

# What known trace flags do: fixed list of flags, own words.
FLAG_TEXTS = {
    "1117": "All files of a filegroup grow together.", "1118": "Every object gets uniform extents.",
    "2371": "Statistics of large tables update sooner.", "3226": "Successful backups stay out of the error log.",
    "7745": "Query Store skips its final write at shutdown or failover.", "7752": "Query Store loads in the background.",
}

AG_IDS = (101, 102, 103, 104, 105, 111, 113, 114, 115, 116, 119, 120, 198, 199)
HEALTH_IDS = (101, 102, 103, 104, 105, 106, 107, 108, 109, 111, 112, 113, 114, 115, 116, 117, 118, 119, 120)
SECURITY_IDS = (100, 101, 102, 103, 104, 105, 116, 117, 119)

AG_WIDE = (101, 102, 103, 104, 105, 111, 115, 120, 116, 199, 198, 119)
HEALTH_WIDE = (101, 102, 103, 104, 105, 106, 107, 108, 109, 110, 111, 112, 113, 114, 115, 120, 116, 117, 119)


def _row_attributes(f: Facts) -> dict[int, Column]:
    protocol = F.concat(F.col("transport"), F.when(F.col("transport") == "TCP", F.concat(F.lit(" on port "), "tcp_port")).otherwise(""))
    return {
        100: F.date_format(f.params.now, "MM/dd/yyyy"), 101: F.coalesce("machine_name", F.lit("")), 102: F.coalesce("instance_name", F.lit("(default instance)")),
        103: F.concat(F.lit("SQL Server "), text_for(F.col("major"), {n: t for t, n in VERSION_NAMES})),
        104: F.col("edition"), 105: F.col("product_version"), 107: F.col("data_path"), 108: F.col("log_path"), 109: F.col("backup_path"),
        111: protocol, 112: F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSS"),
        113: F.concat(F.col("cpu_count"), F.lit(" core(s) across "), F.expr("cpu_count div hyperthread_ratio"), F.lit(" CPU socket(s)")),
        114: F.expr("physical_memory_kb div 1024").cast("string"), 119: F.coalesce("net_address", F.lit("UNKNOWN")),
    }


def attributes(f: Facts, ids: tuple[int, ...]) -> DataFrame:
    """The wanted attributes as raw findings: one scan of the instances and one of the log."""
    parts = []
    columns = {i: c for i, c in _row_attributes(f).items() if i in ids}
    known = F.col("major").isin([n for _, n in VERSION_NAMES])
    parts.append(rule_scan(f.instances, [RowRule(i, known if i == 103 else F.lit(True), object=c) for i, c in columns.items()]))

    maker = r"(?i)System Manufacturer: '(.*?)', System Model: '(.*?)'\."
    from_log = {
        106: (F.col("log_file_line").isNotNull() & F.col("collected_as_sysadmin"),
              F.regexp_extract("log_file_line", r"(?i)Logging SQL Server messages in file '(.*?)'\.", 1)),
        115: (F.col("version_line").isNotNull(), F.expr("substring(version_line, locate('Windows', version_line))")),
        120: (F.col("maker_line").isNotNull(),
              F.concat_ws(": ", F.regexp_extract("maker_line", maker, 1), F.regexp_extract("maker_line", maker, 2))),
    }
    wanted = [RowRule(i, test, object=text) for i, (test, text) in from_log.items() if i in ids]
    if wanted:
        parts.append(rule_scan(f.log_facts.join(f.gate.select("instance_id", "collected_as_sysadmin"), "instance_id"), wanted))
    if 116 in ids:
        parts.append(raw(f.services.where(fold("servicename").startswith("sql server (")), 116, None, "service_account"))
    if 117 in ids:
        parts.append(raw(f.services.where(F.col("kind") == "agent"), 117, None, "service_account"))
    if 118 in ids:
        n = f.fleet["installed_instances"].groupBy("instance_id").agg(F.count("installed_name").alias("n"))
        parts.append(f.only(raw(n, 118, None, F.col("n").cast("string")), "collected_as_sysadmin"))
    if 198 in ids or 199 in ids:
        rights = endpoint_rights(f)
        parts += [raw(rights, 198, None, "can_connect"), raw(rights, 199, None, "is_sysadmin")]
    return union(*parts)


def trace_flags(f: Facts) -> DataFrame:
    """110: each flag in use with what it does."""
    text = F.concat_ws(": ", "trace_flag", text_for(F.col("trace_flag"), FLAG_TEXTS, "Look up this trace flag."))
    return raw(f.fleet["trace_flags"], 110, None, text)


def wide(f: Facts, ids: tuple[int, ...]) -> DataFrame:
    """One row per instance with a column per attribute, in the order given."""
    rows = attributes(f, tuple(i for i in ids if i != 110))
    attrs = rows.select("instance_id", text_for(F.col("check_id"), NAMES).alias("attr"), F.col("object_name").alias("details"))
    if 110 in ids:
        flags = string_list(f.fleet["trace_flags"], ["instance_id"], "trace_flag", "details")
        attrs = attrs.unionByName(flags.withColumn("attr", F.lit(NAMES[110])).select("instance_id", "attr", "details"))
    return attributes_wide(attrs, [NAMES[i] for i in ids])


def group_profile(f: Facts) -> list[DataFrame]:
    return [f.in_groups(attributes(f, AG_IDS)), f.only(f.in_groups(trace_flags(f)), "collected_as_sysadmin")]


def health_profile(f: Facts) -> list[DataFrame]:
    return [attributes(f, HEALTH_IDS), trace_flags(f)]


def security_profile(f: Facts) -> list[DataFrame]:
    return [attributes(f, SECURITY_IDS)]
