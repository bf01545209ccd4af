"""Organisations, members, invites and sign-on, as joins over tables.

``memberships``: user_id, org_id, role, joined_at. ``users``: user_id, email, email_verified, is_active.
``orgs``: org_id, name, is_personal, created_at, sso_domain, sso_default_role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv


def role_rank(role: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in fv.ROLE_RANK.items() for x in pair])[role]


def visible_rows(rows: DataFrame, memberships: DataFrame, user: str | int, min_role: str = "viewer", org: str = "org_id") -> DataFrame:
    """Rows of the organisations in which a user has at least a role."""
    allowed = memberships.where((F.col("user_id") == user) & (role_rank(F.col("role")) >= fv.ROLE_RANK[min_role]))
    return rows.join(allowed.select(F.col("org_id").alias(org)), org, "left_semi")


def access_decisions(requests: DataFrame, memberships: DataFrame) -> DataFrame:
    """Add ``decision`` to requests (user_id, org_id, min_role): allowed, forbidden, or not_found for outsiders."""
    known = memberships.select("user_id", "org_id", "role")
    met = requests.join(known, ["user_id", "org_id"], "left")
    enough = role_rank(F.col("role")) >= role_rank(F.col("min_role"))
    return met.withColumn("decision", F.when(F.col("role").isNull(), "not_found").when(enough, "allowed").otherwise("forbidden"))


def orgs_for(memberships: DataFrame, orgs: DataFrame) -> DataFrame:
    """Every user's organisations with the role, personal ones first, then by age."""
    return (memberships.select("user_id", "org_id", "role").join(orgs, "org_id")
            .select("user_id", "org_id", "name", "role", "is_personal", "created_at")
            .orderBy("user_id", F.desc("is_personal"), "created_at", "org_id"))


def list_members(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Members of every organisation in the order of joining."""
    return (memberships.join(users, "user_id").select("org_id", "user_id", "email", "name", "role", "joined_at")
            .orderBy("org_id", "joined_at", "user_id"))


def owner_counts(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("org_id").agg(F.count_if(F.col("role") == "owner").alias("owners"))


def last_owner_guard(changes: DataFrame, memberships: DataFrame) -> DataFrame:
    """Requested changes (org_id, user_id, new_role; null removes) that would leave an organisation without an owner."""
    current = memberships.select("org_id", "user_id", "role")
    met = changes.join(current, ["org_id", "user_id"]).join(owner_counts(memberships), "org_id")
    return met.where((F.col("role") == "owner") & ~F.col("new_role").eqNullSafe("owner") & (F.col("owners") <= 1))


def role_changes(changes: DataFrame, memberships: DataFrame, orgs: DataFrame) -> DataFrame:
    """Add ``outcome`` to requests (org_id, actor_id, user_id, new_role; null removes).

    The checks are made in the order a request meets them; the first that fails names the outcome.
    """
    actor = memberships.select("org_id", F.col("user_id").alias("actor_id"), F.col("role").alias("actor_role"))
    target = memberships.select("org_id", "user_id", "role")
    met = (changes.join(actor, ["org_id", "actor_id"], "left").join(target, ["org_id", "user_id"], "left")
           .join(owner_counts(memberships), "org_id", "left").join(orgs.select("org_id", "is_personal"), "org_id", "left"))
    removal, leaving = F.col("new_role").isNull(), F.col("actor_id") == F.col("user_id")
    own = F.col("role") == "owner"
    below_admin = role_rank(F.col("actor_role")) < fv.ROLE_RANK["admin"]
    not_owner = F.col("actor_role") != "owner"
    touches_owner = F.when(removal, own & ~leaving).otherwise(own | (F.col("new_role") == "owner"))
    demotes = own & ~F.col("new_role").eqNullSafe("owner")
    return met.withColumn("outcome", (
        F.when(F.col("actor_role").isNull(), "not_found")
        .when(below_admin & ~(removal & leaving), "forbidden")
        .when(F.col("role").isNull(), "no_member")
        .when(touches_owner & not_owner, "owners_only")
        .when(demotes & (F.col("owners") <= 1), "last_owner")
        .when(removal & leaving & F.col("is_personal"), "personal")
        .otherwise("applied")))


def domain_auto_join(users: DataFrame, memberships: DataFrame, orgs: DataFrame) -> DataFrame:
    """New memberships of verified users whose e-mail domain an organisation claims; nobody becomes an owner this way."""
    claimed = orgs.where("sso_domain IS NOT NULL").select("org_id", F.col("sso_domain").alias("domain"), "sso_default_role")
    verified = users.where("email_verified").select("user_id", F.substring_index("email", "@", -1).alias("domain"))
    role = F.when(F.col("sso_default_role") == "owner", "member").otherwise(F.col("sso_default_role"))
    joined = verified.join(claimed, "domain").select("user_id", "org_id", role.alias("role"))
    return joined.join(memberships.select("user_id", "org_id"), ["user_id", "org_id"], "left_anti")


def pending_invites(invites: DataFrame) -> DataFrame:
    """The newest unaccepted invite of every organisation and e-mail address, newest first.

    ``invites``: invite_id, org_id, email, role, created_at, expires_at, accepted_at.
    """
    open_ = invites.where("accepted_at IS NULL").withColumn("email", F.lower("email"))
    newest = open_.groupBy("org_id", "email").agg(F.max(F.struct("created_at", "invite_id")).alias("n"))
    keys = newest.select("org_id", "email", "n.invite_id")
    return open_.join(keys, ["org_id", "email", "invite_id"], "left_semi").orderBy("org_id", F.desc("created_at"), F.desc("invite_id"))


def redeemable_invites(invites: DataFrame, users: DataFrame, memberships: DataFrame, now: Column) -> DataFrame:
    """Memberships that pending, unexpired invites give to users with the same address who are no members yet."""
    valid = pending_invites(invites).where(F.col("expires_at") > now)
    met = valid.join(users.select("user_id", F.lower("email").alias("email")), "email")
    fresh = met.join(memberships.select("user_id", "org_id"), ["user_id", "org_id"], "left_anti")
    return fresh.select("user_id", "org_id", "role", "invite_id")


def member_counts(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("org_id").agg(
        F.count("*").alias("members"), F.count_if(F.col("role") == "owner").alias("owners"))


def account_deletions(users: DataFrame, memberships: DataFrame) -> DataFrame:
    """``user_id, blocked, orphans``: whether an account may not be deleted, as it solely owns an organisation that has
    other members, and how many organisations would go with it."""
    counts = member_counts(memberships)
    owned = memberships.where("role = 'owner'").select("user_id", "org_id").join(counts, "org_id")
    per_user = owned.groupBy("user_id").agg(
        F.bool_or((F.col("owners") == 1) & (F.col("members") > 1)).alias("blocked"),
        F.count_if(F.col("members") == 1).alias("orphans"))
    return users.select("user_id").join(per_user, "user_id", "left").select(
        "user_id", F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("orphans", F.lit(0)).alias("orphans"))


def orphan_orgs(memberships: DataFrame, deleted: DataFrame) -> DataFrame:
    """Organisations that go with deleted users (user_id), having no other member."""
    owned = memberships.where("role = 'owner'").join(deleted.select("user_id"), "user_id", "left_semi")
    single = member_counts(memberships).where("members = 1").select("org_id")
    return owned.select("org_id", "user_id").join(single, "org_id", "left_semi")


def slugify(name: Column) -> Column:
    """Lower case, other characters as single hyphens, at most 50 characters."""
    text = F.btrim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    short = F.substring(text, 1, fv.SLUG_CHARS)
    return F.when(short == "", "org").otherwise(short)


def unique_slugs(orgs: DataFrame) -> DataFrame:
    """Add ``slug``; all but the oldest of equal slugs get a suffix made from the id, so no ranking is needed.

    The first of a slug is found by an aggregation that combines before the shuffle.
    """
    named = orgs.withColumn("__base", slugify(F.col("name")))
    first = named.groupBy("__base").agg(F.min("org_id").alias("__first"))
    suffix = F.concat("__base", F.lit("-"), F.substring(F.sha2(F.col("org_id").cast("string"), 256), 1, 8))
    met = named.join(first, "__base")
    return met.withColumn("slug", F.when(F.col("org_id") == F.col("__first"), F.col("__base")).otherwise(suffix)).drop("__base", "__first")


def domain_claims(claims: DataFrame) -> DataFrame:
    """``org_id, domain, status`` of claims (org_id, domain): ok, invalid, or taken if several claim one domain."""
    domain = F.ltrim(F.lower("domain"), F.lit("@"))
    clean = claims.withColumn("domain", domain)
    counts = clean.groupBy("domain").agg(F.countDistinct("org_id").alias("claimants"))
    met = clean.join(counts, "domain", "left")
    status = F.when(~F.coalesce(F.col("domain").rlike(fv.DOMAIN.replace("$", r"\z")), F.lit(False)), "invalid").when(F.col("claimants") > 1, "taken")
    return met.select("org_id", "domain", status.alias("s")).select("org_id", "domain", F.coalesce("s", F.lit("ok")).alias("status"))


def resolve_identities(profiles: DataFrame, users: DataFrame, identities: DataFrame) -> DataFrame:
    """``provider, subject, user_id, outcome, drop_password`` of sign-on profiles (provider, subject, email, email_verified).

    A known identity wins over the e-mail address; an address links only if the profile's is verified, and the
    password of an account that never proved its address is dropped.
    """
    known = identities.select("provider", "subject", F.col("user_id").alias("linked"))
    linked_user = users.select(F.col("user_id").alias("linked"), F.col("is_active").alias("linked_active"))
    by_mail = users.select(F.col("user_id").alias("owner"), "email", F.col("is_active").alias("owner_active"),
                           F.col("email_verified").alias("owner_verified"))
    met = (profiles.join(known, ["provider", "subject"], "left").join(linked_user, "linked", "left").join(by_mail, "email", "left"))
    has_link, has_owner = F.col("linked").isNotNull(), F.col("owner").isNotNull()
    verified = F.coalesce(F.col("email_verified"), F.lit(False))
    outcome = (
        F.when(has_link & ~F.coalesce("linked_active", F.lit(False)), "disabled")
        .when(has_link, "known")
        .when(F.coalesce("email", F.lit("")) == "", "no_email")
        .when(has_owner & ~verified, "conflict")
        .when(has_owner & ~F.col("owner_active"), "disabled")
        .when(has_owner, "linked")
        .otherwise("created"))
    judged = met.withColumn("outcome", outcome)
    return judged.select(
        "provider", "subject", F.when(F.col("outcome") == "known", F.col("linked")).when(F.col("outcome") == "linked", F.col("owner")).alias("user_id"),
        "outcome", ((F.col("outcome") == "linked") & ~F.col("owner_verified")).alias("drop_password"))
