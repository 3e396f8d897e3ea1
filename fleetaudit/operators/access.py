"""Privileges, ownership and passwords."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def privilege_audit(principals: DataFrame, grants: DataFrame, on: Sequence[tuple[str, str]],
                    grant_filter: Column | None = None, exceptions: Column | None = None) -> DataFrame:
    """Principals that hold a grant, less the exceptions.

    ``on`` pairs a principal column with a grant column. Both filters run before the semi join,
    and only the distinct grant keys are shuffled.
    """
    held = grants if grant_filter is None else grants.where(grant_filter)
    held = held.select(*[F.col(g).alias(f"_g{i}") for i, (_, g) in enumerate(on)]).distinct()
    who = principals if exceptions is None else principals.where(~F.coalesce(exceptions, F.lit(False)))
    cond = F.lit(True)
    for i, (p, _) in enumerate(on):
        cond = cond & (F.col(p) == F.col(f"_g{i}"))
    return who.join(held, cond, "left_semi")


def role_members(principals: DataFrame, memberships: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Membership rows with role and member resolved: role_id, role_name, member_id, member_name,
    member_type. One level, as stored."""
    def side(prefix: str) -> DataFrame:
        return principals.select(*keys, F.col("principal_id").alias(f"{prefix}_id"),
                                 F.col("name").alias(f"{prefix}_name"), F.col("type").alias(f"{prefix}_type"))

    links = memberships.select(*keys, F.col("role_principal_id").alias("role_id"),
                               F.col("member_principal_id").alias("member_id"))
    return (links.join(side("role"), [*keys, "role_id"])
            .join(side("member"), [*keys, "member_id"]))


def ownership_audit(objects: DataFrame, principals: DataFrame, owner: str = "owner_sid", sid: str = "sid",
                    keys: Sequence[str] = ("instance_id",), carry: Sequence[str] = ("name", "type")) -> DataFrame:
    """Objects with their owner's columns as ``owner_<column>`` and ``owner_known``.

    A left join on the owner id: the caller's predicate then picks unknown, unexpected, Windows
    or privileged owners from one result.
    """
    dim = principals.select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col(sid).alias("_p_sid"),
                            *[F.col(c).alias(f"owner_{c}") for c in carry], F.lit(True).alias("_known"))
    cond = F.col(owner) == F.col("_p_sid")
    for k in keys:
        cond = cond & (objects[k] == F.col(f"_p_{k}"))
    return (objects.join(dim, cond, "left")
            .withColumn("owner_known", F.coalesce("_known", F.lit(False)))
            .drop("_known", "_p_sid", *[f"_p_{k}" for k in keys]))


def credential_dictionary_audit(logins: DataFrame, candidates: Sequence[tuple[str, str]], name: str = "name",
                                salt: str = "salt", digest: str = "digest",
                                own_name: str | None = "own name") -> DataFrame:
    """Logins whose digest is that of a candidate word with the login's salt.

    ``candidates`` pairs a label with a word. The list sits in code and each login is hashed
    against it in place: no join, no shuffle. ``own_name`` labels the test of the login's own name.
    """
    def fits(word: Column) -> Column:
        return F.sha2(F.concat(F.col(salt).cast("string"), word), 256) == F.lower(F.col(digest))

    tests = [(label, F.lit(word)) for label, word in candidates]
    if own_name:
        tests.append((own_name, F.col(name)))
    found = F.array(*[F.when(fits(word), F.lit(label)) for label, word in tests])
    return logins.withColumn("weakness", F.explode(found)).where(F.col("weakness").isNotNull())


WORDS_A_CHUNK = 2_000
LOGINS_A_GROUP = 10_000


def credential_dictionary_join(logins: DataFrame, words: DataFrame, name: str = "name", salt: str = "salt", digest: str = "digest",
                               own_name: str | None = "own name", chunk: int = WORDS_A_CHUNK, group: int = LOGINS_A_GROUP) -> DataFrame:
    """O27 with a table of words (``weakness``, ``word``) of any size.

    Salted digests leave no way but to hash each word with each salt. Words are dealt to chunks and
    logins to groups by hash, both of about a fixed size, and each chunk meets each group under a key of the two:
    a task holds one chunk of words at a time and hashes a bounded block, however long either side is.
    Logins that share salt and digest are tested once. Null words, salts and digests fit nothing.
    """
    own = F.lower(F.col(digest))
    pairs = logins.select(F.col(salt).cast("string").alias("_salt"), own.alias("_digest")).where("_salt IS NOT NULL AND _digest IS NOT NULL").distinct()
    listed = words.where(F.col("word").isNotNull()).select("weakness", "word").distinct()
    chunks, groups = (max(1, -(-df.count() // size)) for df, size in ((listed, chunk), (pairs, group)))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # A group holds every chunk once; a login meets the chunks of its group.
    lists = (listed.groupBy(F.pmod(F.xxhash64("word"), F.lit(chunks)).cast("int").alias("_chunk")).agg(F.collect_list(F.struct("weakness", "word")).alias("_words"))
             .withColumn("_group", numbers(groups)))
    dealt = pairs.withColumn("_group", F.pmod(F.xxhash64("_salt", "_digest"), F.lit(groups)).cast("int")).withColumn("_chunk", numbers(chunks))
    fits = F.filter("_words", lambda w: F.sha2(F.concat(F.col("_salt"), w["word"]), 256) == F.col("_digest"))
    hits = dealt.join(lists, ["_chunk", "_group"]).select("_salt", "_digest", F.explode(fits).alias("_hit")).select("_salt", "_digest", F.col("_hit.weakness").alias("weakness"))
    found = logins.join(hits, (F.col(salt).cast("string") == F.col("_salt")) & (own == F.col("_digest"))).drop("_salt", "_digest")
    if own_name:
        test = F.sha2(F.concat(F.col(salt).cast("string"), F.col(name)), 256) == own
        found = found.unionByName(logins.where(test).withColumn("weakness", F.lit(own_name)))
    return found


def resolve_securable(permissions: DataFrame, securables: DataFrame, keys: Sequence[str],
                      code: str = "class", object_id: str = "major_id", name: str = "object_name") -> DataFrame:
    """The object's name by class and id, from one long dimension; null when unknown."""
    dim = securables.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("class").alias("_s_class"),
                            F.col("id").alias("_s_id"), F.col("name").alias(name))
    cond = (F.col(code) == F.col("_s_class")) & (F.col(object_id) == F.col("_s_id"))
    for k in keys:
        cond = cond & (permissions[k] == F.col(f"_s_{k}"))
    return permissions.join(dim, cond, "left").drop("_s_class", "_s_id", *[f"_s_{k}" for k in keys])
