"""Queries over organisations, members, invites and sign-on."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import tenancy as ten
from . import inputs
from .registry import Tables, query

RANK = "CASE {c} " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in fv.ROLE_RANK.items()) + " END"
BASE = f"WITH users AS ({inputs.USERS}), orgs AS ({inputs.ORGS}), memberships AS ({inputs.MEMBERSHIPS}), owners AS (SELECT org_id, count(*) FILTER (role = 'owner') AS owners, count(*) AS members FROM memberships GROUP BY org_id)"

@query("visible_rows", f"{BASE} SELECT org_id, name FROM orgs WHERE org_id IN (SELECT org_id FROM memberships WHERE user_id = 30 AND {RANK.format(c='role')} >= 0) ")
def visible_rows(t: Tables):
    """Organisations one user can see."""
    return ten.visible_rows(t.sql(inputs.ORGS), t.sql(inputs.MEMBERSHIPS), 30).select("org_id", "name")


REQUESTS = """SELECT o_orderkey AS request_id, o_custkey AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || CAST(o_custkey AS STRING) ELSE 'n' || CAST(o_orderkey % 25 AS STRING) END AS org_id,
 CASE o_orderkey % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'member' WHEN 2 THEN 'admin' ELSE 'owner' END AS min_role FROM orders"""


@query("access_decisions", f"{BASE}, requests AS ({REQUESTS}) SELECT request_id, CASE WHEN role IS NULL THEN 'not_found' WHEN {RANK.format(c='role')} >= {RANK.format(c='min_role')} THEN 'allowed' ELSE 'forbidden' END AS decision "
       "FROM requests LEFT JOIN memberships USING (user_id, org_id)")
def access_decisions(t: Tables):
    """Requests allowed, forbidden, or hidden from outsiders."""
    return ten.access_decisions(t.sql(REQUESTS), t.sql(inputs.MEMBERSHIPS)).select("request_id", "decision")


@query("orgs_for", f"{BASE} SELECT user_id, org_id, name, role, is_personal::INT::BIGINT AS is_personal FROM memberships JOIN orgs USING (org_id)")
def orgs_for(t: Tables):
    """Organisations of every user."""
    found = ten.orgs_for(t.sql(inputs.MEMBERSHIPS), t.sql(inputs.ORGS))
    return found.select("user_id", "org_id", "name", "role", F.col("is_personal").cast("bigint").alias("is_personal"))


@query("list_members", f"{BASE} SELECT org_id, user_id, email, name, role, joined_at FROM memberships JOIN users USING (user_id)")
def list_members(t: Tables):
    """Members of every organisation."""
    return ten.list_members(t.sql(inputs.MEMBERSHIPS), t.sql(inputs.USERS))


@query("last_owner_guard", f"{BASE}, changes AS ({inputs.CHANGES}) SELECT org_id, user_id FROM changes JOIN memberships m USING (org_id, user_id) JOIN owners USING (org_id) WHERE m.role = 'owner' AND coalesce(new_role, '') <> 'owner' AND owners <= 1")
def last_owner_guard(t: Tables):
    """Changes that would leave an organisation without an owner."""
    return ten.last_owner_guard(t.sql(inputs.CHANGES), t.sql(inputs.MEMBERSHIPS)).select("org_id", "user_id")


@query("role_changes", f"""{BASE}, changes AS ({inputs.CHANGES}),
met AS (SELECT c.*, a.role AS actor_role, m.role, owners, is_personal, c.new_role IS NULL AS removal, c.actor_id = c.user_id AS leaving FROM changes c
 LEFT JOIN memberships a ON a.org_id = c.org_id AND a.user_id = c.actor_id LEFT JOIN memberships m ON m.org_id = c.org_id AND m.user_id = c.user_id
 LEFT JOIN owners o ON o.org_id = c.org_id LEFT JOIN orgs ON orgs.org_id = c.org_id)
SELECT org_id, actor_id, user_id, CASE WHEN actor_role IS NULL THEN 'not_found' WHEN {RANK.format(c='actor_role')} < 2 AND NOT (removal AND leaving) THEN 'forbidden' WHEN role IS NULL THEN 'no_member'
 WHEN actor_role <> 'owner' AND CASE WHEN removal THEN role = 'owner' AND NOT leaving ELSE role = 'owner' OR new_role = 'owner' END THEN 'owners_only'
 WHEN role = 'owner' AND coalesce(new_role, '') <> 'owner' AND owners <= 1 THEN 'last_owner' WHEN removal AND leaving AND is_personal THEN 'personal' ELSE 'applied' END AS outcome FROM met""")
def role_changes(t: Tables):
    """Outcome of requested role changes and removals."""
    done = ten.role_changes(t.sql(inputs.CHANGES), t.sql(inputs.MEMBERSHIPS), t.sql(inputs.ORGS))
    return done.select("org_id", "actor_id", "user_id", "outcome")


@query("domain_auto_join", f"""{BASE} SELECT u.user_id, o.org_id, CASE WHEN sso_default_role = 'owner' THEN 'member' ELSE sso_default_role END AS role FROM users u JOIN orgs o ON o.sso_domain = split_part(u.email, '@', 2)
 WHERE email_verified AND NOT EXISTS (SELECT 1 FROM memberships m WHERE m.user_id = u.user_id AND m.org_id = o.org_id)""")
def domain_auto_join(t: Tables):
    """Memberships that come from a verified e-mail domain."""
    return ten.domain_auto_join(t.sql(inputs.USERS), t.sql(inputs.MEMBERSHIPS), t.sql(inputs.ORGS))


PENDING = f"invites AS ({inputs.INVITES}), pending AS (SELECT *, lower(email) AS mail FROM invites WHERE accepted_at IS NULL QUALIFY row_number() OVER (PARTITION BY org_id, lower(email) ORDER BY created_at DESC, invite_id DESC) = 1)"


@query("pending_invites", f"WITH {PENDING} SELECT invite_id, org_id, mail AS email, role, created_at FROM pending")
def pending_invites(t: Tables):
    """Newest open invite of every address."""
    return ten.pending_invites(t.sql(inputs.INVITES)).select("invite_id", "org_id", "email", "role", "created_at")


@query("redeemable_invites", f"""{BASE}, {PENDING} SELECT u.user_id, p.org_id, p.role, p.invite_id FROM pending p JOIN users u ON lower(u.email) = p.mail
 WHERE p.expires_at > 900 AND NOT EXISTS (SELECT 1 FROM memberships m WHERE m.user_id = u.user_id AND m.org_id = p.org_id)""")
def redeemable_invites(t: Tables):
    """Memberships open invites would give."""
    return ten.redeemable_invites(t.sql(inputs.INVITES), t.sql(inputs.USERS), t.sql(inputs.MEMBERSHIPS), F.lit(900))


@query("account_deletions", f"""{BASE} SELECT u.user_id, coalesce(bool_or(m.role = 'owner' AND owners = 1 AND members > 1), false)::INT::BIGINT AS blocked, count(*) FILTER (m.role = 'owner' AND members = 1) AS orphans
 FROM users u LEFT JOIN memberships m ON m.user_id = u.user_id LEFT JOIN owners o ON o.org_id = m.org_id GROUP BY u.user_id""")
def account_deletions(t: Tables):
    """Accounts that may not be deleted, and organisations that would go with the others."""
    return ten.account_deletions(t.sql(inputs.USERS), t.sql(inputs.MEMBERSHIPS)).select("user_id", F.col("blocked").cast("bigint").alias("blocked"), "orphans")


@query("orphan_orgs", f"{BASE} SELECT m.org_id, m.user_id FROM memberships m JOIN owners USING (org_id) JOIN users u ON u.user_id = m.user_id WHERE m.role = 'owner' AND members = 1 AND NOT u.is_active")
def orphan_orgs(t: Tables):
    """Organisations that go with the inactive users."""
    return ten.orphan_orgs(t.sql(inputs.MEMBERSHIPS), t.sql(inputs.USERS).where("NOT is_active"))


SLUG = "CASE WHEN {s} = '' THEN 'org' ELSE {s} END".format(s="left(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), 50)")


@query("unique_slugs", f"{BASE}, s AS (SELECT org_id, {SLUG} AS base FROM orgs) SELECT org_id, CASE WHEN org_id = min(org_id) OVER (PARTITION BY base) THEN base ELSE base || '-' || left(sha256(org_id), 8) END AS slug FROM s")
def unique_slugs(t: Tables):
    """Slugs of organisations, made unique."""
    return ten.unique_slugs(t.sql(inputs.ORGS)).select("org_id", "slug")


CLAIMS = """SELECT 'p' || CAST(c_custkey AS STRING) AS org_id, CASE c_custkey % 6 WHEN 0 THEN '@Team' || CAST(c_custkey % 50 AS STRING) || '.Example.com' WHEN 1 THEN '-bad.example.com' WHEN 2 THEN 'nodots'
 WHEN 3 THEN 'own' || CAST(c_custkey AS STRING) || '.io' WHEN 4 THEN 'a_b.com' ELSE 'shared.org' END AS domain FROM customer"""


@query("domain_claims", f"""WITH c AS ({CLAIMS}), d AS (SELECT org_id, ltrim(lower(domain), '@') AS domain FROM c)
SELECT org_id, domain, CASE WHEN NOT regexp_matches(domain, '{fv.DOMAIN}') THEN 'invalid' WHEN count(*) OVER (PARTITION BY domain) > 1 THEN 'taken' ELSE 'ok' END AS status FROM d""")
def domain_claims(t: Tables):
    """Domains that are valid and claimed once."""
    return ten.domain_claims(t.sql(CLAIMS))


PROFILES = """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'idp-a' ELSE 'idp-b' END AS provider, 's' || CAST(o_orderkey AS STRING) AS subject,
 CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'new' || CAST(o_orderkey AS STRING) || '@else.org' ELSE 'user' || CAST(o_custkey AS STRING) || '@mail.example.org' END AS email,
 o_orderkey % 5 <> 2 AS email_verified FROM orders"""
LINKS = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'idp-a' ELSE 'idp-b' END AS provider, 's' || CAST(o_orderkey AS STRING) AS subject, o_custkey AS user_id FROM orders WHERE o_orderstatus = 'F'"


@query("resolve_identities", f"""{BASE}, profiles AS ({PROFILES}), links AS ({LINKS}),
met AS (SELECT p.*, l.user_id AS linked, lu.is_active AS linked_active, o.user_id AS owner, o.is_active AS owner_active, o.email_verified AS owner_verified FROM profiles p LEFT JOIN links l USING (provider, subject)
 LEFT JOIN users lu ON lu.user_id = l.user_id LEFT JOIN users o ON o.email = p.email),
j AS (SELECT *, CASE WHEN linked IS NOT NULL AND NOT coalesce(linked_active, false) THEN 'disabled' WHEN linked IS NOT NULL THEN 'known' WHEN email = '' THEN 'no_email' WHEN owner IS NOT NULL AND NOT email_verified THEN 'conflict'
 WHEN owner IS NOT NULL AND NOT owner_active THEN 'disabled' WHEN owner IS NOT NULL THEN 'linked' ELSE 'created' END AS outcome FROM met)
SELECT provider, subject, CASE outcome WHEN 'known' THEN linked WHEN 'linked' THEN owner END AS user_id, outcome, coalesce(outcome = 'linked' AND NOT owner_verified, false)::INT::BIGINT AS drop_password FROM j""")
def resolve_identities(t: Tables):
    """Users that sign-on profiles lead to."""
    found = ten.resolve_identities(t.sql(PROFILES), t.sql(inputs.USERS), t.sql(LINKS))
    return found.select("provider", "subject", "user_id", "outcome", F.coalesce(F.col("drop_password").cast("bigint"), F.lit(0)).alias("drop_password"))
