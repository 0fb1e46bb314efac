"""SQL counterparts of the named queries, written independently of the operators.

They read the same benchmark tables through the same adapter expressions and are run by another
engine to check row counts and values.
"""

import re

from meterfold import fixed_values as fv
from meterfold.plans import adapters as a

_NOW_ISO = a.NOW.replace(" ", "T") + "+00:00"
_NOW_SHOWN = a.NOW[:19]


# --- building blocks -----------------------------------------------------------------------

def dialect(text: str) -> str:
    def packed(found):
        return "struct_pack(" + ", ".join(f"{c} := {c}" for c in found.group(1).split(", ")) + ")"

    return re.sub(r"\{struct: ([^}]*)\}", packed, text).replace("{ntz}", "TIMESTAMP")


def cte(spec) -> str:
    table, columns = spec
    body = ", ".join(f'{dialect(sql)} AS "{c}"' for c, sql in columns.items())
    return f"(SELECT {body} FROM {table})"


def lit(text) -> str:
    return "CAST(NULL AS VARCHAR)" if text is None else "'" + str(text).replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(fv.WHITESPACE)})"


def clean(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def day(x: str) -> str:
    return (f"CASE WHEN regexp_full_match({strip(x)}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') "
            f"THEN CAST(try_strptime({strip(x)}, '%Y-%m-%d') AS DATE) END")


def boolean(x: str) -> str:
    return (f"CASE WHEN lower({strip(x)}) IN ('true', 'vrai', '1', 'yes') THEN TRUE "
            f"WHEN lower({strip(x)}) IN ('false', 'faux', '0', 'no') THEN FALSE END")


def email_ok(x: str) -> str:
    return rf"(length({x}) <= 100 AND regexp_matches({x}, '^[^@\s]+@[^@\s]+\.[^@\s]+$'))"


def isin(x: str, words) -> str:
    return f"coalesce({x} IN ({', '.join(lit(w) for w in words)}), FALSE)"


def shown(x: str) -> str:
    """ISO text as YYYY-MM-DD HH:MM:SS, other text unchanged."""
    s = clean(x)
    stamp = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}:[0-9]{2}.*)?$"
    parsed = f"try_cast(replace(left({s}, 19), 'T', ' ') AS TIMESTAMP)"
    return (f"CASE WHEN regexp_matches({s}, '{stamp}') AND {parsed} IS NOT NULL "
            f"THEN strftime({parsed}, '%Y-%m-%d %H:%M:%S') ELSE {s} END")


def payload_json(x: str) -> str:
    s = clean(x)
    return (f"CASE WHEN lower({s}) = 'null' THEN NULL WHEN {s} LIKE '{{%' THEN {s} "
            f"ELSE '\"' || {s} || '\"' END")


def t(key: str, champ=None, **kw) -> str:
    return fv.TEXT[key].format(champ=champ, **kw)


class Rules:
    """Numbered rules: a CASE giving the first broken one, and its field and message."""

    def __init__(self):
        self.rows: list[tuple[int, str, str | None, str | None]] = []

    def case(self, *rules) -> str:
        """``rules``: (condition, champ, message). Returns SQL for the number of the first broken."""
        whens = []
        for condition, champ, message in rules:
            number = len(self.rows) + 1
            self.rows.append((number, fv.INVALID_FIELD, champ, message))
            whens.append(f"WHEN {condition} THEN {number}")
        return "CASE " + " ".join(whens) + " END"

    def pick(self, number: str, part: int) -> str:
        whens = " ".join(f"WHEN {r[0]} THEN {lit(r[part])}" for r in self.rows if r[part] is not None)
        return f"CASE {number} {whens} END" if whens else "NULL"


def body_columns(body: dict) -> str:
    return ", ".join(
        f"({present}) AS has_{c}, CASE WHEN {present} THEN CAST({value} AS VARCHAR) END AS b_{c}"
        for c, (present, value) in body.items())


def commands_cte(lines: tuple, body: dict, op: str) -> str:
    table, seq, target = lines
    return f"(SELECT {dialect(seq)} AS seq, {target} AS id, {op} AS op, {body_columns(body)} FROM {table})"


# --- creation rules ------------------------------------------------------------------------

def _gas_create(r: Rules) -> str:
    b = lambda c: f"b_{c}"
    need = lambda c: (f"{clean(b(c))} IS NULL", c, t("required", c))
    dated = lambda c: [need(c), (f"{day(b(c))} IS NULL", c, t("date", c))]
    longer = lambda c, n: (f"length({clean(b(c))}) > {n}", c, t("too_long", c, n=n))
    start, end = "date_debut_droit_acces", "date_fin_droit_acces"
    rs, nm = "raison_sociale_du_titulaire", "nom_titulaire"
    flags = list(zip(fv.GAS_PERIMETERS, ("TRUE", "TRUE", "FALSE", "TRUE")))
    return r.case(
        need("id_pce"), longer("id_pce", 20),
        need("partner"), (f"lower({strip(b('partner'))}) <> 'ifpeb'", "partner",
                          t("one_of", "partner", choices="ifpeb")),
        need("platform_code"), longer("platform_code", 10),
        need("courriel_titulaire"),
        (f"NOT {email_ok(clean(b('courriel_titulaire')))}", "courriel_titulaire",
         t("email", "courriel_titulaire", n=100)),
        need("code_postal"),
        (f"NOT regexp_full_match({strip(b('code_postal'))}, '[0-9]{{5}}')", "code_postal", t("postal")),
        *dated(start), *dated(end),
        (f"{day(b(end))} <= {day(b(start))}", end, t("order", start=start, end=end)),
        *dated("perim_donnees_conso_debut"), *dated("perim_donnees_conso_fin"),
        (f"{clean(b(rs))} IS NULL AND {clean(b(nm))} IS NULL", rs, t("holder", a=rs, b=nm)),
        longer(rs, 200), longer(nm, 40),
        *[(f"{b(c)} IS NOT NULL AND ({boolean(b(c))}) IS NULL", c, t("boolean", c)) for c, _ in flags],
        ("NOT (" + " OR ".join(f"coalesce({boolean(b(c))}, {d})" for c, d in flags) + ")",
         None, t("perimeter")),
    )


def _elec_create(r: Rules) -> str:
    b = lambda c: f"b_{c}"
    need = lambda c: (f"{clean(b(c))} IS NULL", c, t("required", c))
    dated = lambda c: [need(c), (f"{day(b(c))} IS NULL", c, t("date", c))]
    longer = lambda c, n: (f"length({clean(b(c))}) > {n}", c, t("too_long", c, n=n))
    spelt = lambda c: (f"{b(c)} IS NOT NULL AND ({boolean(b(c))}) IS NULL", c, t("boolean", c))
    start, end = "date_debut_autorisation", "date_fin_autorisation"
    return r.case(
        need("id_pdl"), longer("id_pdl", 14),
        need("partner"), (f"lower({strip(b('partner'))}) <> 'ifpeb'", "partner",
                          t("one_of", "partner", choices="ifpeb")),
        need("platform_code"), longer("platform_code", 10),
        *dated("date_signature_mandat"), *dated(start), *dated(end),
        (f"{day(b(end))} <= {day(b(start))}", end, t("order", start=start, end=end)),
        (f"{clean(b('raison_sociale'))} IS NULL AND {clean(b('nom'))} IS NULL", "raison_sociale",
         t("holder", a="raison_sociale", b="nom")),
        longer("raison_sociale", 100), longer("nom", 50), longer("prenom", 50),
        (f"upper({clean(b('civilite'))}) NOT IN ('M', 'MME')", "civilite", t("civility")),
        need("injection"), spelt("injection"), need("soutirage"), spelt("soutirage"),
        spelt("get_cdc"), spelt("get_dm"),
        (f"NOT ({boolean(b('injection'))}) AND NOT ({boolean(b('soutirage'))})", None,
         t("pair", a="soutirage", b="injection")),
        (f"NOT coalesce({boolean(b('get_cdc'))}, TRUE) AND NOT coalesce({boolean(b('get_dm'))}, TRUE)",
         None, t("pair", a="get_cdc", b="get_dm")),
    )


def _creation(body: dict, rule, allowed, extra: str) -> tuple[str, Rules]:
    """CTE text of judged creations; ``extra`` is the only field outside the list."""
    r = Rules()
    number = rule(r)
    assert extra not in allowed
    sql = (f"(SELECT *, CASE WHEN has_{extra} THEN -1 ELSE {number} END AS broken "
           f"FROM {commands_cte(a.CREATES, body, lit('create'))})")
    return sql, r


def _creation_error(r: Rules, extra: str) -> str:
    return f"""CASE WHEN broken = -1 THEN '{fv.UNKNOWN_FIELD}' WHEN broken IS NOT NULL
                THEN '{fv.INVALID_FIELD}' END AS erreur,
           CASE WHEN broken = -1 THEN '{extra}' ELSE {r.pick('broken', 2)} END AS champ,
           CASE WHEN broken = -1 THEN {lit(t('unknown', extra))} ELSE {r.pick('broken', 3)} END AS message"""


def validate_create(body, rule, allowed, extra) -> str:
    judged, r = _creation(body, rule, allowed, extra)
    return f"SELECT seq, {_creation_error(r, extra)} FROM {judged}"


def create(body, rule, allowed, extra, key, registry, status, codes, texts) -> str:
    judged, r = _creation(body, rule, allowed, extra)
    return f"""
    WITH j AS (SELECT seq, {clean('b_' + key)} AS id, broken, {_creation_error(r, extra)} FROM {judged}),
    reg AS {cte(registry)},
    won AS (SELECT id, min(seq) AS first_seq FROM j WHERE broken IS NULL GROUP BY id),
    o AS (SELECT j.*, reg.{key} IS NOT NULL AS stored, reg.{status} AS st, first_seq
          FROM j LEFT JOIN reg ON j.id = reg.{key} LEFT JOIN won ON j.id = won.id)
    SELECT seq, id, 'create' AS op,
      CASE WHEN broken IS NOT NULL THEN 400 WHEN stored OR seq > first_seq THEN 409 ELSE 201 END AS http_status,
      CASE WHEN broken IS NULL AND (stored OR seq > first_seq) THEN {lit(codes['exists'])} ELSE erreur END AS erreur,
      champ,
      CASE WHEN broken IS NOT NULL THEN message WHEN stored OR seq > first_seq THEN {lit(texts['exists'])}
           ELSE {lit(texts['created'])} END AS message,
      CASE WHEN broken IS NOT NULL THEN NULL WHEN stored THEN coalesce({clean('st')}, 'nouveau')
           ELSE 'nouveau' END AS statut
    FROM o"""


# --- patch, retry, revoke ------------------------------------------------------------------

class GasBook:
    key, status, registry = "id_pce", "etat_droit_acces", a.GAS_REGISTRY
    codes, texts = fv.GAS_CODES, fv.GAS_TEXT
    retryable, revocable = fv.GAS_RETRYABLE, fv.GAS_REVOCABLE
    gone, revoked = fv.GAS_ALREADY_REVOKED, fv.GAS_REVOKED
    lines, strays, body, unlisted = a.GAS_LINES, a.GAS_STRAYS, a.GAS_PATCH, "partner"
    start, end = "date_debut_droit_acces", "date_fin_droit_acces"
    carried = ("courriel_titulaire", "code_postal", start, end, "raison_sociale_du_titulaire",
               "nom_titulaire", *fv.GAS_PERIMETERS)
    rs, nm = "raison_sociale_du_titulaire", "nom_titulaire"

    def normal(self, c):
        """Normal form of a patched field."""
        x = f"b_{c}"
        if c in (self.start, self.end):
            return f"CAST({day(x)} AS VARCHAR)"
        return boolean(x) if c in fv.GAS_PERIMETERS else clean(x)

    def facts(self, r: Rules) -> str:
        mail, post = "courriel_titulaire", "code_postal"
        dates = ("perim_donnees_conso_debut", self.start, self.end)
        early = r.case(
            (f"has_{mail} AND NOT coalesce({email_ok(clean('b_' + mail))}, FALSE)", mail,
             t("email", mail, n=100)),
            (f"has_{post} AND NOT coalesce(regexp_full_match({strip('b_' + post)}, '[0-9]{{5}}'), FALSE)",
             post, t("postal")),
            *[(f"has_{c} AND ({day('b_' + c)}) IS NULL", c, t("date", c)) for c in dates],
        )
        middle = r.case(*[
            (f"has_{c} AND length({clean('b_' + c)}) > {n}", c, t("too_long", c, n=n))
            for c, n in ((self.rs, 200), (self.nm, 40))])
        late = r.case(*[(f"has_{c} AND ({boolean('b_' + c)}) IS NULL", c, t("boolean", c))
                        for c in fv.GAS_PERIMETERS])
        return f"{early} AS early, {middle} AS middle, {late} AS late"

    def crosses(self, r: Rules, m) -> tuple[str, str, str]:
        """Rules that need the stored row, in between the body-only ones; ``m``: merged field."""
        order = r.case((f"(has_{self.start} OR has_{self.end}) AND ({day(m(self.end))}) <= ({day(m(self.start))})",
                        self.end, t("order", start=self.start, end=self.end)))
        holder = r.case((f"(has_{self.rs} OR has_{self.nm}) AND {clean(m(self.rs))} IS NULL "
                         f"AND {clean(m(self.nm))} IS NULL", self.rs, t("holder", a=self.rs, b=self.nm)))
        perims = fv.GAS_PERIMETERS
        any_has = " OR ".join(f"has_{c}" for c in perims)
        any_true = " OR ".join(f"coalesce({m(c)}, FALSE)" for c in perims)
        last = r.case((f"({any_has}) AND NOT ({any_true})", None, t("perimeter")))
        return order, holder, last


class ElecBook(GasBook):
    key, status, registry = "id_pdl", "statut", a.PDL
    codes, texts = fv.ELEC_CODES, fv.ELEC_TEXT
    retryable, revocable = fv.ELEC_RETRYABLE, fv.ELEC_REVOCABLE
    gone, revoked = fv.ELEC_ALREADY_REVOKED, fv.ELEC_REVOKED
    lines, strays, body, unlisted = a.ELEC_LINES, a.ELEC_STRAYS, a.ELEC_PATCH, "id_pdl"
    start, end = "date_debut_autorisation", "date_fin_autorisation"
    carried = (start, end, "raison_sociale", "nom", *fv.ELEC_FLAGS)
    rs, nm = "raison_sociale", "nom"

    def normal(self, c):
        x = f"b_{c}"
        if c in (self.start, self.end):
            return day(x)
        return f"CAST({boolean(x)} AS VARCHAR)" if c in fv.ELEC_FLAGS else clean(x)

    def facts(self, r: Rules) -> str:
        early = r.case(*[(f"has_{c} AND ({day('b_' + c)}) IS NULL", c, t("date", c))
                         for c in fv.ELEC_DATES])
        middle = r.case(
            (f"has_civilite AND upper({clean('b_civilite')}) NOT IN ('M', 'MME')", "civilite", t("civility")),
            *[(f"has_{c} AND length({clean('b_' + c)}) > {n}", c, t("too_long", c, n=n))
              for c, n in (("raison_sociale", 100), ("nom", 50))])
        late = r.case(
            (f"has_prenom AND length({clean('b_prenom')}) > 50", "prenom", t("too_long", "prenom", n=50)),
            *[(f"has_{c} AND ({boolean('b_' + c)}) IS NULL", c, t("boolean", c)) for c in fv.ELEC_FLAGS])
        return f"{early} AS early, {middle} AS middle, {late} AS late"

    def crosses(self, r: Rules, m):
        order = r.case((f"(has_{self.start} OR has_{self.end}) AND {m(self.end)} <= {m(self.start)}",
                        self.end, t("order", start=self.start, end=self.end)))
        holder = r.case((f"(has_{self.rs} OR has_{self.nm}) AND {clean(m(self.rs))} IS NULL "
                         f"AND {clean(m(self.nm))} IS NULL", self.rs, t("holder", a=self.rs, b=self.nm)))
        pair = lambda x, y: (
            f"(has_{x} OR has_{y}) AND NOT (coalesce({m(x)} = 'true', FALSE) "
            f"OR coalesce({m(y)} = 'true', FALSE))", None, t("pair", a=x, b=y))
        last = r.case(pair("soutirage", "injection"), pair("get_cdc", "get_dm"))
        return order, holder, last


def _facts_cte(book, r: Rules, commands: str, numbered: bool) -> str:
    normal = ", ".join(f"{book.normal(c)} AS n_{c}" for c in book.carried)
    rank = ", row_number() OVER (PARTITION BY id ORDER BY seq) AS n" if numbered else ""
    return f"(SELECT *, {book.facts(r)}, {normal}{rank} FROM {commands})"


def _code(book, r: Rules, state: str) -> str:
    """Outcome number: 0 accepted, rule numbers, or 1000+ for the state machine."""
    m = lambda c: f"(CASE WHEN has_{c} THEN n_{c} ELSE {state}.{c} END)"
    order, holder, last = book.crosses(r, m)
    st = clean(f"{state}.{book.status}")
    none = " AND ".join(f"NOT has_{c}" for c in book.body)
    return f"""CASE WHEN NOT {state}.known THEN 1001
      WHEN op = 'patch' THEN CASE WHEN has_{book.unlisted} THEN 1002 WHEN {none} THEN 1003
        ELSE coalesce(early, {order}, middle_after_holder({holder}), late, {last}, 0) END
      WHEN op = 'retry' THEN CASE WHEN {isin(st, book.retryable)} THEN 0 ELSE 1004 END
      ELSE CASE WHEN {isin(st, book.gone)} THEN 1005 WHEN {isin(st, book.revocable)} THEN 0
        ELSE 1006 END END"""


def _code_sql(book, r: Rules, state: str) -> str:
    sql = _code(book, r, state)
    start = sql.index("middle_after_holder(")
    depth, i = 0, start + len("middle_after_holder")
    for j in range(i, len(sql)):
        depth += {"(": 1, ")": -1}.get(sql[j], 0)
        if depth == 0:
            break
    holder = sql[i + 1:j]
    # Gas checks the holder before the lengths, electricity after them.
    ordered = f"middle, {holder}" if isinstance(book, ElecBook) else f"{holder}, middle"
    return sql[:start] + ordered + sql[j + 1:]


def _outcome(book, r: Rules, state: str) -> str:
    st = clean(f"{state}.{book.status}")
    tx, cd = book.texts, book.codes
    return f"""seq.*, id, op,
      CASE WHEN code = 0 THEN 200 WHEN code IN (1001, 1005) THEN 404 WHEN code IN (1004, 1006) THEN 409
           ELSE 400 END AS http_status,
      CASE code WHEN 0 THEN NULL WHEN 1001 THEN '{cd['missing']}' WHEN 1005 THEN '{cd['revoked']}'
           WHEN 1002 THEN '{fv.READ_ONLY_FIELD}' WHEN 1004 THEN '{fv.WRONG_STATE}'
           WHEN 1006 THEN '{fv.WRONG_STATE}' ELSE '{fv.INVALID_FIELD}' END AS erreur,
      CASE WHEN code = 1002 THEN '{book.unlisted}' ELSE {r.pick('code', 2)} END AS champ,
      CASE WHEN code = 0 AND op = 'retry' THEN {lit(tx['retried'])}
           WHEN code = 0 AND op = 'revoke' THEN {lit(tx['revoked'])}
           WHEN code = 1001 THEN {lit(tx['missing'])} WHEN code = 1005 THEN {lit(tx['already_revoked'])}
           WHEN code = 1002 THEN {lit(t('read_only', book.unlisted))}
           WHEN code = 1003 THEN {lit(t('empty_patch'))}
           WHEN code = 1004 THEN {lit(tx['not_retryable'])} WHEN code = 1006 THEN {lit(tx['not_revocable'])}
           ELSE {r.pick('code', 3)} END AS message,
      CASE WHEN code = 0 AND op = 'revoke' THEN '{book.revoked}' WHEN code = 0 THEN 'nouveau'
           WHEN code IN (1004, 1006) THEN {st} END AS statut"""


def judge(book, op: str) -> str:
    r = Rules()
    facts = _facts_cte(book, r, commands_cte(book.strays, book.body, lit(op)), False)
    code = _code_sql(book, r, "w")
    cols = ", ".join(f"reg.{c}" for c in (book.status, *book.carried))
    return f"""
    WITH reg AS {cte(book.registry)}, c AS {facts},
    w AS (SELECT c.*, reg.{book.key} IS NOT NULL AS known, {cols}
          FROM c LEFT JOIN reg ON c.id = reg.{book.key}),
    d AS (SELECT w.*, {code} AS code FROM w)
    SELECT {_outcome(book, r, 'd')} FROM d"""


def fold(book, final: bool = False, lines: tuple | None = None) -> str:
    r = Rules()
    facts = _facts_cte(book, r, commands_cte(lines or book.lines, book.body, a.LINE_OP), True)
    code = _code_sql(book, r, "w")
    carried = (book.status, *book.carried)
    extra = ("nb_tentatives_declare", "message_erreur_declare") if final else ()
    state = ", ".join(f"reg.{c}" for c in (*carried, *extra))
    after = [f"CASE WHEN d.code <> 0 THEN d.{book.status} WHEN op = 'revoke' THEN '{book.revoked}' "
             f"ELSE 'nouveau' END"]
    after += [f"CASE WHEN d.code = 0 AND op = 'patch' AND has_{c} THEN n_{c} ELSE d.{c} END"
              for c in book.carried]
    if final:
        after += ["CASE WHEN d.code = 0 AND op <> 'revoke' THEN 0 ELSE d.nb_tentatives_declare END",
                  "CASE WHEN d.code = 0 AND op <> 'revoke' THEN NULL ELSE d.message_erreur_declare END"]
    names = (*carried, *extra)
    step = ", ".join(f"{x} AS {c}" for x, c in zip(after, names))
    keep = ", ".join(names)
    tail = f"SELECT {_outcome(book, r, 'd')} FROM d"
    if final:
        shown_cols = ("id_pce", "etat_droit_acces", "code_postal", "courriel_titulaire",
                      "date_debut_droit_acces", "date_fin_droit_acces",
                      "raison_sociale_du_titulaire", "nom_titulaire", *fv.GAS_PERIMETERS,
                      "nb_tentatives_declare", "message_erreur_declare")
        ends = ", ".join(f"coalesce_end.{c}" for c in shown_cols if c != "id_pce")
        tail = f"""SELECT reg.id_pce, {', '.join(f'CASE WHEN e.id IS NULL THEN reg.{c} ELSE e.{c} END AS {c}'
                   for c in shown_cols if c != 'id_pce')}
        FROM reg LEFT JOIN (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1) e
          ON reg.id_pce = e.id"""
        del ends
    return f"""
    WITH RECURSIVE reg AS {cte(book.registry)}, c AS {facts},
    walk AS (
      SELECT reg.{book.key} AS id, CAST(1 AS BIGINT) AS n, TRUE AS known, {state} FROM reg
      UNION ALL
      SELECT id, n + 1, known, {step} FROM (
        SELECT w.*, c.* EXCLUDE (id, n), {code} AS code
        FROM walk w JOIN c ON c.id = w.id AND c.n = w.n) d
    ),
    unknown AS (SELECT c.id, c.n, FALSE AS known, {', '.join(f'NULL AS {c}' for c in names)}
                FROM c WHERE NOT EXISTS (SELECT 1 FROM reg WHERE reg.{book.key} = c.id)),
    every AS (SELECT id, n, known, {keep} FROM walk UNION ALL SELECT * FROM unknown),
    d AS (SELECT w.*, c.* EXCLUDE (id, n), {code} AS code
          FROM every w JOIN c ON c.id = w.id AND c.n = w.n)
    {tail}"""


# --- reads ---------------------------------------------------------------------------------

def _gas_view(source: str, light: bool = False) -> str:
    flags = ", ".join(fv.GAS_PERIMETERS)
    dates = "" if light else (
        f"{clean('date_debut_droit_acces')} AS date_debut_droit_acces, "
        f"{shown('date_creation')} AS date_creation, ")
    return f"""SELECT {clean('id_pce')} AS id_pce, {clean('partner')} AS partner,
      {clean('platform_code')} AS platform_code,
      coalesce({clean('etat_droit_acces')}, 'nouveau') AS statut, {flags}, {dates}
      {clean('date_fin_droit_acces')} AS date_fin_droit_acces, {shown('derniere_maj')} AS derniere_maj,
      {payload_json('message_erreur_declare')} AS message_erreur FROM {source}"""


def _elec_view(source: str) -> str:
    flag = lambda c: f"CASE {c} WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS {c}"
    stamp = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"
    return f"""SELECT {clean('id_pdl')} AS id_pdl, {clean('partner')} AS partner,
      {clean('platform_code')} AS platform_code, {clean('statut')} AS statut,
      {flag('statut_cdc')}, {flag('statut_dm')}, {payload_json('erreur')} AS message_erreur,
      {stamp('date_creation')}, {stamp('date_modification')} FROM {source}"""


def _lookup(view: str, key: str, ids: str, codes, texts) -> str:
    return f"""SELECT i.{key}, v.* EXCLUDE ({key}),
      CASE WHEN v.{key} IS NULL THEN 404 ELSE 200 END AS http_status,
      CASE WHEN v.{key} IS NULL THEN '{codes['missing']}' END AS erreur,
      CASE WHEN v.{key} IS NULL THEN {lit(texts['missing'])} END AS message
    FROM (SELECT DISTINCT {ids} AS {key} FROM lineitem) i LEFT JOIN ({view}) v ON v.{key} = i.{key}"""


_DUMP = "id_pce, etat_droit_acces, role_tiers, raison_sociale_du_titulaire, derniere_maj"
_REG, _PDL = cte(a.GAS_REGISTRY), cte(a.PDL)
_KEYED = "id_pdl, label, ts"
_LATEST = f"QUALIFY row_number() OVER (PARTITION BY {_KEYED} ORDER BY arrival DESC) = 1"
_HALVES = f"""WITH m AS {cte(a.MEASURES)},
    t AS (SELECT * FROM m WHERE arrival % 2 = 0 {_LATEST}),
    s AS (SELECT * FROM m WHERE arrival % 2 = 1 {_LATEST})"""
_MATCH = "t.id_pdl = s.id_pdl AND t.label = s.label AND t.ts = s.ts"

_PERIODS = f"""(SELECT 'grdf' AS provider, id_pce AS sensor_id, date_debut, date_fin, consommation,
        unite, {day('date_debut')} AS d1, {day('date_fin')} AS d2 FROM {cte(a.GAS_PERIODS)}
      UNION ALL
      SELECT 'enedis', id_pdl, CAST(date_debut AS VARCHAR), CAST(date_fin AS VARCHAR), val, NULL,
        date_debut, date_fin FROM {cte(a.MEASURES)} WHERE label = 'TOTAL')"""
_SHOWN_PERIOD = f"""provider, sensor_id, {clean('date_debut')} AS date_debut, {clean('date_fin')} AS date_fin,
      consommation, coalesce({clean('unite')}, 'kWh') AS unite"""


def _checked_requests() -> tuple[str, Rules]:
    r = Rules()
    low, high = day('"from"'), day('"to"')
    provider = f"lower({clean('provider')})"
    number = r.case(
        (f"{provider} IS NULL", "provider", t("required", "provider")),
        (f"{provider} NOT IN ('grdf', 'enedis')", "provider", t("provider_choice")),
        (f"{clean('sensor_id')} IS NULL", "sensor_id", t("required", "sensor_id")),
        (f"({low}) IS NULL", "from", t("date", "from")),
        (f"({high}) IS NULL", "to", t("date", "to")),
        (f"({high}) <= ({low})", "to", t("window")),
    )
    return (f"(SELECT req_id, {provider} AS provider, {clean('sensor_id')} AS sensor_id, "
            f"{low} AS low, {high} AS high, {number} AS broken FROM {cte(a.REQUESTS)})"), r


def _listing_checks() -> str:
    r, states = Rules(), fv.GAS_STATES
    whole = lambda c: f"regexp_full_match({c}, '[+-]?[0-9]+')"
    number = r.case(
        (f"statut NOT IN ({', '.join(lit(x) for x in states)})", "statut", t("status_choice", choices=", ".join(states))),
        (f"NOT {whole('lim')}", "limit", t("int_between", "limit", bound="entre 1 et 100")),
        ("CAST(lim AS BIGINT) NOT BETWEEN 1 AND 100", "limit", t("int_bound", "limit", bound="entre 1 et 100")),
        (f"NOT {whole('off')}", "offset", t("int_between", "offset", bound="≥ 0")),
        ("CAST(off AS BIGINT) < 0", "offset", t("int_bound", "offset", bound="≥ 0")))
    return f"""
    SELECT req_id, statut,
      CASE WHEN lim IS NULL THEN 50 WHEN {whole('lim')} AND CAST(lim AS BIGINT) BETWEEN 1 AND 100 THEN CAST(lim AS BIGINT) END AS "limit",
      CASE WHEN off IS NULL THEN 0 WHEN {whole('off')} AND CAST(off AS BIGINT) >= 0 THEN CAST(off AS BIGINT) END AS "offset",
      CASE WHEN broken IS NOT NULL THEN '{fv.INVALID_FIELD}' END AS erreur, {r.pick('broken', 2)} AS champ,
      {r.pick('broken', 3)} AS message
    FROM (SELECT *, {number} AS broken FROM (
      SELECT req_id, {clean('statut')} AS statut, {clean('"limit"')} AS lim, {clean('"offset"')} AS off FROM {cte(a.LISTINGS)}))"""


def _consumption_requests() -> str:
    q, _ = _checked_requests()
    return f"""SELECT req_id, {_SHOWN_PERIOD} FROM (
      SELECT q.req_id, p.* FROM {q} q JOIN {_PERIODS} p USING (provider, sensor_id)
      WHERE q.broken IS NULL AND p.d1 >= q.low AND p.d2 <= q.high)"""


def _consumption_outcome(latest: str = "") -> str:
    """``latest``: a clause that narrows the measurements before anything is read of them."""
    q, r = _checked_requests()
    measures = cte(a.MEASURES)
    periods = _PERIODS.replace(f"FROM {measures} WHERE", f"FROM (SELECT * FROM {measures} {latest}) WHERE")
    return f"""
    WITH q AS {q}, p AS {periods},
    k AS (SELECT DISTINCT 'grdf' AS provider, id_pce AS sensor_id FROM {cte(a.GAS_PERIODS)}
          UNION SELECT DISTINCT 'enedis', id_pdl FROM {cte(a.MEASURES)}),
    n AS (SELECT q.req_id, count(*) AS n FROM q JOIN p USING (provider, sensor_id)
          WHERE broken IS NULL AND d1 >= low AND d2 <= high GROUP BY 1)
    SELECT q.req_id, q.provider, q.sensor_id,
      CASE WHEN broken IS NOT NULL THEN 400 WHEN k.sensor_id IS NULL THEN 404 ELSE 200 END AS http_status,
      CASE WHEN broken IS NOT NULL THEN '{fv.INVALID_FIELD}' WHEN k.sensor_id IS NULL
           THEN '{fv.SENSOR_NOT_FOUND}' END AS erreur,
      {r.pick('broken', 2)} AS champ,
      CASE WHEN broken IS NOT NULL THEN {r.pick('broken', 3)} WHEN k.sensor_id IS NULL
           THEN {lit(t('sensor_missing'))} END AS message,
      CASE WHEN broken IS NULL AND k.sensor_id IS NOT NULL THEN coalesce(n.n, 0) END AS n_kept
    FROM q LEFT JOIN k USING (provider, sensor_id) LEFT JOIN n ON n.req_id = q.req_id"""


def _feed() -> str:
    table, columns = a.UPSERT_FEED
    fields = {c: f"CASE WHEN {on} THEN {v} END" for c, (on, v) in a.UPSERT_FIELDS.items()}
    has = {f"has_{c}": on for c, (on, _) in a.UPSERT_FIELDS.items()}
    return cte((table, {**columns, **fields, **has}))


def _registry_upsert() -> str:
    def merged(c, old):
        return f"CASE WHEN s.id_pce IS NOT NULL AND s.has_{c} THEN s.{c} ELSE {old} END AS {c}"

    cols = ", ".join(merged(c, f"t.{c}" if c in a.GAS_REGISTRY[1] else "NULL") for c in a.UPSERT_FIELDS)
    return f"""
    WITH t AS {_REG}, s AS (SELECT * FROM {_feed()} WHERE id_pce <> '' QUALIFY row_number() OVER (
        PARTITION BY id_pce ORDER BY coalesce(date_debut_droit_acces, '') DESC,
        coalesce(date_creation, '') DESC, input_ord) = 1)
    SELECT coalesce(t.id_pce, s.id_pce) AS id_pce, t.partner, {cols},
      CASE WHEN s.id_pce IS NOT NULL THEN '{_NOW_ISO}' ELSE t.derniere_maj END AS derniere_maj
    FROM t FULL JOIN s ON t.id_pce = s.id_pce"""


def _offered() -> str:
    _, seq, target = a.GAS_STRAYS
    return (f"(SELECT {target} AS id_pce, 'proposé' || l_linestatus AS etat_droit_acces, "
            f"{dialect(seq)} AS seq FROM lineitem)")


def _quality(source, table: str, missing, extra, checks) -> str:
    parts = [f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{rule}' AS rule, "
             f"CAST(NULL AS BIGINT) AS n_violations, CAST(NULL AS VARCHAR) AS example"
             for rule, names in (("missing", missing), ("extra", extra)) for c in names]
    for column, rule, broken in checks:
        example = "CAST(NULL AS VARCHAR)" if rule == "not_null" else f"min({column})"
        parts.append(f"SELECT '{table}', '{column}', '{rule}', count(*), {example} "
                     f"FROM {cte(source)} WHERE {broken} HAVING count(*) > 0")
    return " UNION ALL ".join(parts)


_PDL_CHECKS = [
    ("id_pdl", "not_null", "id_pdl IS NULL"),
    ("id_pdl", "max_length", "length(id_pdl) > 14"),
    ("partner", "max_length", "length(partner) > 100"),
    ("platform_code", "not_null", "platform_code IS NULL"),
    ("platform_code", "max_length", "length(platform_code) > 10"),
    ("injection", "enum", "injection NOT IN ('true', 'false')"),
    ("get_cdc", "not_null", "get_cdc IS NULL"),
    ("get_cdc", "enum", "get_cdc NOT IN ('true', 'false')"),
    ("statut", "not_null", "statut IS NULL"),
    ("statut", "enum", "statut NOT IN ('nouveau', 'processing', 'traite', 'erreur', 'partiel', "
                       "'revoque', 'résilié')"),
    ("commentaire", "max_length", "length(commentaire) > 50"),
]
_DTC_CHECKS = [
    ("id_pdl", "not_null", "id_pdl IS NULL"),
    ("id_pdl", "max_length", "length(id_pdl) > 14"),
    ("etat_contractuel", "max_length", "length(etat_contractuel) > 6"),
    ("segment", "max_length", "length(segment) > 5"),
    ("segment", "enum", "segment NOT IN ('C1', 'C2', 'C3', 'C4', 'C5', 'P1', 'P2', 'P3', 'P4')"),
    ("matricule", "max_length", "length(matricule) > 50"),
]


def _dq_report() -> str:
    missing_pdl = sorted({
        "civilite", "date_creation", "date_debut_autorisation", "date_fin_autorisation",
        "date_modification", "date_premiere_valeur_dm", "date_signature_mandat", "erreur", "get_dm",
        "nom", "prenom", "raison_sociale", "soutirage", "statut_cdc", "statut_dm"})
    missing_dtc = sorted({
        "batiment", "code_insee", "code_postal", "commune", "escalier_etage_appartement", "lieu_dit",
        "longue_utilisation_contexte", "media_releve", "mode_releve", "mode_traitement",
        "numero_voie", "periodicite_releve", "plage_releve", "puissance_souscrite_max_unite",
        "puissance_souscrite_max_valeur", "tension_livraison", "type_compteur"})
    return " UNION ALL ".join([
        _quality(a.FAULTY_PDL, "pdl", missing_pdl, ["extra_col"], _PDL_CHECKS),
        _quality(a.FAULTY_DTC, "dtc", missing_dtc, [], _DTC_CHECKS)])


def _with_row_errors() -> str:
    labels = ", ".join(f"CASE WHEN {broken} THEN '{c}:{rule}' END" for c, rule, broken in _PDL_CHECKS)
    return f"SELECT *, concat_ws(',', {labels}) AS row_errors FROM {cte(a.FAULTY_PDL)}"


def _dq_quarantine() -> str:
    return f"""SELECT partner, id_pdl, row_errors FROM ({_with_row_errors()}) WHERE row_errors <> ''"""


def _mark_collected() -> str:
    stamps = ", ".join(
        f"bool_or(collection_type = '{k}') AS has_{c}" for k, c in fv.COLLECTION_STAMPS.items())
    stored = {"dernier_appel_techniques"}
    stored_or_null = lambda c: f"r.{c}" if c in stored else "NULL"
    # Calls to meters that are not registered create rows.
    cols = ", ".join(
        f"CASE WHEN c.id_pce IS NOT NULL AND c.has_{c} THEN '{_NOW_ISO}' ELSE {stored_or_null(c)} END AS {c}"
        for c in fv.COLLECTION_STAMPS.values())
    return f"""
    WITH r AS {_REG}, c AS (SELECT id_pce, {stamps}, arg_max(status_code, call_ord) AS code
                            FROM {cte(a.CALLS)} GROUP BY id_pce)
    SELECT coalesce(r.id_pce, c.id_pce) AS id_pce, {cols}, CAST(c.code AS INTEGER) AS api_response_code,
      CASE WHEN c.id_pce IS NOT NULL THEN '{_NOW_ISO}' ELSE r.derniere_maj END AS derniere_maj
    FROM r FULL JOIN c ON r.id_pce = c.id_pce"""


def _mark_onboarded() -> str:
    return f"""
    WITH r AS {_REG}, c AS (SELECT id_pce, arg_max(status_code, call_ord) AS code
                            FROM {cte(a.CALLS)} GROUP BY id_pce)
    SELECT coalesce(r.id_pce, c.id_pce) AS id_pce,
      CASE WHEN c.id_pce IS NOT NULL THEN '{_NOW_ISO}' END AS date_onboard_history,
      CAST(c.code AS INTEGER) AS api_response_onboard_history,
      CASE WHEN c.id_pce IS NOT NULL THEN '{_NOW_ISO}' ELSE r.derniere_maj END AS derniere_maj
    FROM r FULL JOIN c ON r.id_pce = c.id_pce"""


def _recent(join: str) -> str:
    latest = f"""(SELECT id_pdl, code_prestation, datetime_requete, id_affaire FROM {cte(a.HISTORY)}
      WHERE datetime_requete >= TIMESTAMP '2024-01-18 00:00:00' QUALIFY row_number() OVER (
      PARTITION BY id_pdl, code_prestation ORDER BY datetime_requete DESC, id_affaire DESC) = 1)"""
    if join == "left":
        return f"""SELECT q.*, strftime(h.datetime_requete, '%Y-%m-%d %H:%M:%S') AS datetime_requete,
          h.id_affaire FROM {cte(a.ASKED)} q LEFT JOIN {latest} h USING (id_pdl, code_prestation)"""
    return f"""SELECT q.* FROM {cte(a.ASKED)} q WHERE NOT EXISTS (SELECT 1 FROM {latest} h
      WHERE h.id_pdl = q.id_pdl AND h.code_prestation = q.code_prestation)"""


def _accept_spaced() -> str:
    # Row n is accepted when it is later than the horizon of the last accepted row before it.
    return f"""
    WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY id_pdl, code_prestation
        ORDER BY datetime_requete, id_affaire) AS n FROM {cte(a.HISTORY)} WHERE datetime_requete IS NOT NULL),
    walk AS (
      SELECT id_pdl, code_prestation, id_affaire, n, datetime_requete AS last, TRUE AS ok FROM h WHERE n = 1
      UNION ALL
      SELECT h.id_pdl, h.code_prestation, h.id_affaire, h.n,
        CASE WHEN h.datetime_requete > w.last + INTERVAL 7 DAY THEN h.datetime_requete ELSE w.last END,
        h.datetime_requete > w.last + INTERVAL 7 DAY
      FROM walk w JOIN h ON h.id_pdl = w.id_pdl AND h.code_prestation = w.code_prestation AND h.n = w.n + 1)
    SELECT id_pdl, code_prestation, id_affaire FROM walk WHERE ok"""


def _status_update() -> str:
    return f"""SELECT t.id_pdl, coalesce(s.statut, t.statut) AS statut,
      coalesce(s.statut_cdc, t.statut_cdc) AS statut_cdc,
      coalesce(left(s.commentaire, 50), t.commentaire) AS commentaire,
      CASE WHEN s.id_pdl IS NOT NULL THEN '{_NOW_SHOWN}'
           ELSE strftime(t.date_modification, '%Y-%m-%d %H:%M:%S') END AS date_modification
    FROM {_PDL} t LEFT JOIN {cte(a.STATUS_UPDATES)} s ON t.id_pdl = s.id_pdl"""


def _error_set_clear() -> str:
    old = lambda k: (
        f"CASE WHEN t.erreur LIKE '{{%' THEN json_extract_string(t.erreur, '$.{k}') END")
    pick = lambda new, k: (
        f"CASE WHEN t.statut = 'traite' THEN NULL WHEN s.id_pdl IS NOT NULL THEN {new} ELSE {old(k)} END")
    return f"""SELECT t.id_pdl, {pick('s.code', 'code_statut_traitement')} AS code,
      {pick('s.message', 'message_retour_traitement')} AS message,
      CASE WHEN t.statut = 'traite' OR s.id_pdl IS NOT NULL THEN '{_NOW_SHOWN}'
           ELSE strftime(t.date_modification, '%Y-%m-%d %H:%M:%S') END AS date_modification
    FROM {_PDL} t LEFT JOIN {cte(a.ERRORS)} s ON t.id_pdl = s.id_pdl"""


def _bool_dialects() -> str:
    w = f"lower({strip('word')})"
    words = lambda yes, no: (
        f"CASE WHEN {w} IN ({yes}) THEN TRUE" + (f" WHEN {w} IN ({no}) THEN FALSE END"))
    return f"""SELECT doc_id, {words("'vrai'", "'faux'")} AS feed,
      {words("'true','vrai','1','yes'", "'false','faux','0','no'")} AS "input",
      {words("'true','vrai','1'", "'false','faux','0'")} AS "view",
      coalesce({w} IN ('true', 'vrai', '1'), FALSE) AS existing,
      {words("'true'", "'false'")} AS existing_text,
      CASE WHEN {w} IN ('true','vrai','1','yes') THEN 'true' WHEN {w} IN ('false','faux','0','no')
           THEN 'false' ELSE 'true' END AS stored_text FROM {cte(a.WORDS)}"""


def _access_audit(allowed: str | None = None, v6: str = "coalesce(host LIKE '2001:db8::%', FALSE)") -> str:
    """``allowed``: SQL condition over the address number ``ip``; the short list when left out."""
    last = "nullif(trim(split_part(x_forwarded_for, ',', -1)), '')"
    host = f"""CASE WHEN {last} LIKE '[%' THEN regexp_extract({last}, '^\\[([^\\]]*)', 1)
      WHEN length({last}) - length(replace({last}, ':', '')) = 1 THEN split_part({last}, ':', 1)
      ELSE {last} END"""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    v4 = f"regexp_full_match(host, '{octet}(\\.{octet}){{3}}')"
    part = lambda i: f"CAST(split_part(host, '.', {i}) AS BIGINT)"
    num = f"({part(1)} * 16777216 + {part(2)} * 65536 + {part(3)} * 256 + {part(4)})"
    n = lambda ip: sum(int(o) << s for o, s in zip(ip.split("."), (24, 16, 8, 0)))
    ranges = [(n("198.51.101.0"), n("198.51.101.255")), (n("203.0.113.0"), n("203.0.113.127")),
              (n("100.64.8.8"), n("100.64.8.8")), (n("198.51.102.77"), n("198.51.102.77"))]
    inside = allowed or " OR ".join(f"ip BETWEEN {lo} AND {hi}" for lo, hi in ranges)
    # The log has two spellings of IPv6 addresses: shortened and with all eight groups.
    short_hex = "'20010db8' || repeat('0', 20) || lpad(split_part(host, '::', 2), 4, '0')"
    full_hex = "'20010db80001' || repeat('0', 16) || lpad(split_part(host, ':', 8), 4, '0')"
    return f"""SELECT event_id,
      CASE WHEN ip IS NOT NULL THEN lpad(lower(to_hex(ip)), 8, '0')
           WHEN host LIKE '2001:db8::%' THEN {short_hex}
           WHEN host LIKE '2001:DB8:1:%' THEN {full_hex} END AS client_hex,
      coalesce({inside}, FALSE) OR {v6} AS allowed
    FROM (SELECT *, CASE WHEN {v4} THEN {num} END AS ip FROM (
      SELECT event_id, {host} AS host FROM {cte(a.ACCESS_LOG)}))"""


_SIX = " UNION ALL ".join(
    f"SELECT '{op}' AS op, id_pce, date_fin_droit_acces FROM {_REG} WHERE date_fin_droit_acces "
    f"{'IS DISTINCT FROM' if op == '!=' else op} '1998-03-15'"
    for op in ("=", "!=", "<", ">", "<=", ">="))
_GAS, _ELEC = GasBook(), ElecBook()
_GAS_RULES = (a.GAS_CREATE, _gas_create, fv.GAS_CREATE_FIELDS, "role_tiers")
_ELEC_RULES = (a.ELEC_CREATE, _elec_create, fv.ELEC_CREATE_FIELDS, "statut")

ORACLES = {
    "consumption_contained": f"""SELECT {_SHOWN_PERIOD} FROM {_PERIODS}
      WHERE provider = 'enedis' AND d1 >= DATE '2024-01-05' AND d2 <= DATE '2024-02-05'""",
    "meter_periods": f"""SELECT {_SHOWN_PERIOD} FROM {_PERIODS} WHERE provider = 'enedis'
      AND sensor_id = '00000000000007' AND d1 >= DATE '2024-01-03' AND d2 <= DATE '2024-02-20'""",
    "measure_conventions": f"SELECT arrival, ts, uuid, fmt FROM {cte(a.MEASURES)}",
    "consumption_union": f"SELECT {_SHOWN_PERIOD} FROM {_PERIODS}",
    "consumption_requests": _consumption_requests(),
    "consumption_outcome": _consumption_outcome(),
    "consumption_lake": _consumption_outcome(_LATEST),
    "gas_meter": f"SELECT * FROM {cte(a.GAS_PERIODS)} WHERE id_pce = 'PCE00000000007'",
    "measures_keep_latest": f"""{_HALVES}
      SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE {_MATCH}) UNION ALL SELECT * FROM s""",
    "measures_merge_stats": f"""{_HALVES}
      SELECT count(*) FILTER (WHERE t.id_pdl IS NULL) AS inserted,
             count(*) FILTER (WHERE t.id_pdl IS NOT NULL) AS updated FROM s LEFT JOIN t ON {_MATCH}""",
    "rights_dedup": f"""WITH f AS {cte(a.RIGHTS_FEED)}
      SELECT * FROM f WHERE id_pce <> '' QUALIFY row_number() OVER (PARTITION BY id_pce ORDER BY
        coalesce(date_debut_droit_acces, '') DESC, coalesce(date_creation, '') DESC, input_ord) = 1
      UNION ALL SELECT * FROM f WHERE id_pce IS NULL OR id_pce = ''""",
    "registry_upsert_partial": _registry_upsert(),
    "lake_upsert": _registry_upsert(),
    "upsert_one": f"""WITH r AS {_REG},
      s AS (SELECT * FROM (VALUES ('PCE00000000007'), ('NEUF')) AS v(id_pce))
      SELECT coalesce(r.id_pce, s.id_pce) AS id_pce, r.partner,
        CASE WHEN s.id_pce IS NULL THEN r.nom_titulaire END AS nom_titulaire,
        CASE WHEN s.id_pce IS NOT NULL THEN 'essai' END AS motif,
        CASE WHEN s.id_pce IS NOT NULL THEN '{_NOW_ISO}' ELSE r.derniere_maj END AS derniere_maj
      FROM r FULL JOIN s ON r.id_pce = s.id_pce""",
    "registry_upsert_stats": f"""WITH f AS {_feed()}, r AS {_REG},
      u AS (SELECT DISTINCT id_pce FROM f WHERE id_pce <> '')
      SELECT (SELECT count(*) FROM u WHERE id_pce NOT IN (SELECT id_pce FROM r)) AS created,
        (SELECT count(*) FROM u WHERE id_pce IN (SELECT id_pce FROM r)) AS updated,
        (SELECT count(*) FROM f WHERE id_pce IS NULL OR id_pce = '') AS errors,
        (SELECT count(*) FROM f WHERE id_pce <> '') - (SELECT count(*) FROM u) AS deduped""",
    "insert_if_absent": f"""WITH r AS {_REG}, s AS {_offered()}
      SELECT id_pce, partner, etat_droit_acces FROM r UNION ALL
      SELECT id_pce, NULL, etat_droit_acces FROM (SELECT * FROM s
        WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id_pce = s.id_pce)
        QUALIFY row_number() OVER (PARTITION BY id_pce ORDER BY seq) = 1)""",
    "insert_errors": f"""SELECT id_pce, input_ord FROM {cte(a.RIGHTS_FEED)}
      WHERE id_pce IS NULL OR id_pce = ''""",
    "append_log": f"""SELECT id_pdl, code AS code_erreur, message AS message_erreur,
      'ConsultationMesures' AS service_appele,
      CASE WHEN code LIKE '%1' THEN '2024-05-05 10:00:00' ELSE '{_NOW_SHOWN}' END AS "timestamp"
      FROM {cte(a.ERRORS)}""",
    "snapshot_roundtrip": f"SELECT id_pce, upper(partner) AS partner, etat_droit_acces FROM {_REG} r",
    "read_one_meter": f"""SELECT id_pdl, label, val, ts FROM (
      SELECT * FROM {cte(a.MEASURES)} {_LATEST}) WHERE id_pdl = '00000000000007'""",
    "insert_conflicts": f"""WITH r AS {_REG}, s AS {_offered()},
      k AS (SELECT s.*, r.id_pce IS NOT NULL AS stored, r.etat_droit_acces AS st,
              row_number() OVER w AS n, first_value(s.etat_droit_acces) OVER w AS first_state
            FROM s LEFT JOIN r ON r.id_pce = s.id_pce WINDOW w AS (PARTITION BY s.id_pce ORDER BY seq))
      SELECT seq.*, id_pce, etat_droit_acces, CASE WHEN stored THEN st ELSE first_state END AS existing_status
      FROM k WHERE stored OR n > 1""",
    "delete_keys": f"""SELECT {_DUMP} FROM {_REG} r WHERE NOT EXISTS (SELECT 1 FROM lineitem
      WHERE l_returnflag = 'R' AND {a.GAS_LINES[2]} = r.id_pce)""",
    "delete_rows": f"""SELECT {_DUMP} FROM {_REG}
      WHERE NOT coalesce(date_fin_droit_acces < '1998-01-01', FALSE)""",
    "update_rows": f"""SELECT id_pdl, get_dm,
      CASE WHEN statut = 'erreur' AND get_dm = 'true' THEN 'partiel' ELSE statut END AS statut,
      CASE WHEN statut = 'erreur' AND get_dm = 'true' THEN 'suite à ' || statut ELSE commentaire END
        AS commentaire FROM {_PDL}""",
    "filter_six_ops": _SIX,
    "lookup_batch": _lookup(_gas_view(_REG), "id_pce",
                            "'PCE' || lpad(CAST(l_orderkey * 2 AS STRING), 11, '0')",
                            fv.GAS_CODES, fv.GAS_TEXT),
    "lookup_batch_elec": _lookup(_elec_view(_PDL), "id_pdl",
                                 "lpad(CAST(l_orderkey * 2 AS STRING), 14, '0')",
                                 fv.ELEC_CODES, fv.ELEC_TEXT),
    "existence": f"""SELECT id_pce, id_pce IN (SELECT id_pce FROM {_REG}) AS known
      FROM (SELECT DISTINCT {a.GAS_STRAYS[2]} AS id_pce FROM lineitem)""",
    "by_state": f"SELECT {_DUMP} FROM {_REG} WHERE etat_droit_acces = 'A revérifier'",
    "active_without_field": f"""SELECT 'techniques' AS todo, id_pce FROM {_REG}
      WHERE etat_droit_acces = 'Active' AND {clean('dernier_appel_techniques')} IS NULL
      UNION ALL SELECT 'onboard', id_pce FROM {_REG} WHERE etat_droit_acces = 'Active'""",
    "list_page": f"""WITH l AS (SELECT * FROM {_REG} WHERE {clean('etat_droit_acces')} = 'Active'),
      p AS (SELECT * FROM l ORDER BY id_pce LIMIT 100 OFFSET 40)
      SELECT v.*, (SELECT count(*) FROM l) AS total FROM ({_gas_view('p', True)}) v""",
    "list_page_elec": f"""WITH l AS (SELECT * FROM {_PDL} WHERE statut = 'traite'),
      p AS (SELECT * FROM l ORDER BY id_pdl LIMIT 50 OFFSET 120)
      SELECT v.*, (SELECT count(*) FROM l) AS total FROM ({_elec_view('p')}) v""",
    "list_page_deep": f"""WITH l AS (SELECT * FROM {_REG}),
      p AS (SELECT * FROM l ORDER BY id_pce LIMIT 100 OFFSET 13500)
      SELECT v.*, (SELECT count(*) FROM l) AS total FROM ({_gas_view('p', True)}) v""",
    "list_page_deep_elec": f"""WITH l AS (SELECT * FROM {_PDL}),
      p AS (SELECT * FROM l ORDER BY id_pdl LIMIT 70 OFFSET 14100)
      SELECT v.*, (SELECT count(*) FROM l) AS total FROM ({_elec_view('p')}) v""",
    "listing_checks": _listing_checks(),
    "list_after_key": f"""SELECT {_DUMP} FROM {_REG} WHERE id_pce > 'PCE00000000700'
      ORDER BY id_pce LIMIT 50""",
    "count_by_status": f"""SELECT coalesce(etat_droit_acces, 'None') AS etat_droit_acces, count(*) AS n
      FROM {_REG} GROUP BY 1""",
    "row_counts": f"SELECT count(*) AS n FROM {_PDL}",
    "collected_meters": f"SELECT id_pdl, statut FROM {_PDL} WHERE statut NOT IN ('nouveau', 'résilié')",
    "gas_views": _gas_view(_REG),
    "elec_views": _elec_view(_PDL),
    "dq_report": _dq_report(),
    "dq_quarantine": _dq_quarantine(),
    "validate_create_gas": validate_create(*_GAS_RULES),
    "validate_create_elec": validate_create(*_ELEC_RULES),
    "create_gas": create(*_GAS_RULES, "id_pce", a.GAS_REGISTRY, "etat_droit_acces",
                         fv.GAS_CODES, fv.GAS_TEXT),
    "create_elec": create(*_ELEC_RULES, "id_pdl", a.PDL, "statut", fv.ELEC_CODES, fv.ELEC_TEXT),
    "validate_patch_gas": judge(_GAS, "patch"),
    "validate_patch_elec": judge(_ELEC, "patch"),
    "state_revoke_gas": judge(_GAS, "revoke"),
    "state_revoke_elec": judge(_ELEC, "revoke"),
    "state_retry_gas": judge(_GAS, "retry"),
    "state_retry_elec": judge(_ELEC, "retry"),
    "command_fold": fold(_GAS),
    "command_fold_state": fold(_GAS, final=True),
    "command_fold_elec": fold(_ELEC),
    "command_fold_hot": fold(_GAS, lines=a.GAS_HOT),
    "recent_request": _recent("left"),
    "suppress_recent": _recent("anti"),
    "accept_spaced": _accept_spaced(),
    "mark_collected": _mark_collected(),
    "mark_onboarded": _mark_onboarded(),
    "status_update": _status_update(),
    "error_set_clear": _error_set_clear(),
    "error_log": f"""SELECT id_pdl, code AS code_erreur, message AS message_erreur,
      'ConsultationMesures' AS service_appele,
      CASE WHEN code LIKE '%1' THEN '2024-05-05 10:00:00' ELSE '{_NOW_SHOWN}' END AS "timestamp"
      FROM {cte(a.ERRORS)}""",
    "history_requests": f"""SELECT id_affaire, id_pdl, code_prestation, 'false' AS mesures_corrigees,
      'COURBES' AS mesures_type_code, CAST(NULL AS VARCHAR) AS mesures_pas,
      DATE '2024-01-05' AS date_debut_demandee, CAST(datetime_requete AS DATE) AS date_fin_demandee,
      '{_NOW_SHOWN}' AS datetime_requete, CAST(NULL AS VARCHAR) AS date_premiere_valeur,
      'false' AS fichier_traite FROM {cte(a.HISTORY)}""",
    "history_requests_store": f"""SELECT id_affaire, id_pdl, code_prestation, 'false' AS mesures_corrigees,
      'COURBES' AS mesures_type_code, CAST(NULL AS VARCHAR) AS mesures_pas,
      DATE '2024-01-05' AS date_debut_demandee, CAST(datetime_requete AS DATE) AS date_fin_demandee,
      '{_NOW_SHOWN}' AS datetime_requete, CAST(NULL AS VARCHAR) AS date_premiere_valeur,
      'false' AS fichier_traite FROM {cte(a.HISTORY)}""",
    "error_payload": f"""SELECT event_id, CASE WHEN lower({clean('raw')}) = 'null' THEN NULL
        ELSE {clean('raw')} END AS text,
      coalesce({clean('raw')} LIKE '{{%', FALSE) AS is_json,
      CASE WHEN {clean('raw')} LIKE '{{%' THEN json_extract_string(raw, '$.k') END AS k
      FROM {cte(a.PAYLOADS)}""",
    "json_commands": f"""SELECT l_orderkey, l_linenumber, json_extract_string(body, '$.code_postal') AS code_postal,
      json_extract_string(body, '$.nom_titulaire') AS nom_titulaire,
      list_contains(json_keys(body), 'nom_titulaire') AS has_nom,
      json_extract_string(body, '$.perim_donnees_publiees') AS perim_donnees_publiees
      FROM {cte(a.JSON_BODIES)}""",
    "lenient_days": f"""SELECT event_id, CASE WHEN regexp_matches({clean('raw')}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
      THEN CAST(try_cast(left({clean('raw')}, 10) AS DATE) AS VARCHAR) END AS day FROM {cte(a.STAMPS)}""",
    "format_timestamps": f"SELECT event_id, {shown('raw')} AS shown FROM {cte(a.STAMPS)}",
    "bool_dialects": _bool_dialects(),
    "migrate_backfill": f"SELECT id_pdl, 'LEGACY' AS platform_code, statut FROM {_PDL}",
    "bronze_archive": f"""SELECT 'lake/bronze/enedis/' || endpoint || '/' || id_pdl || '/{_NOW_SHOWN.replace(' ', 'T').replace(':', '-')}'
        || CASE WHEN suffix <> '' THEN '__' || suffix ELSE '' END || '.xml' AS blob_path, arrival,
        md5(xml) AS xml_md5 FROM {cte(a.RESPONSES)}
      QUALIFY row_number() OVER (PARTITION BY blob_path ORDER BY arrival) = 1""",
    "migrate_store": f"SELECT id_pdl, 'LEGACY' AS platform_code, statut FROM {_PDL}",
    "archive_store": f"""SELECT endpoint, id_pdl, arrival, md5(xml) AS xml_md5, '{_NOW_SHOWN[:10]}' AS day
      FROM {cte(a.RESPONSES)} QUALIFY row_number() OVER (
        PARTITION BY endpoint, id_pdl, coalesce(suffix, '') ORDER BY arrival % 3 <> 0, arrival) = 1""",
    "access_audit": _access_audit(),
    "access_refusals": f"""SELECT event_id, client_hex, 403 AS http_status, '{fv.IP_REFUSED}' AS erreur,
      '{fv.TEXT["ip_refused"].replace("'", "''")}' AS message FROM ({_access_audit()}) WHERE NOT allowed""",
    # 198.51.100-103.even, and 100.64.k.* for every third k.
    "access_audit_many": _access_audit(
        f"(ip // 1024 = {((198 * 256 + 51) * 256 + 100) // 4} AND ip % 2 = 0) OR "
        f"(ip // 65536 = {100 * 256 + 64} AND (ip // 256) % 256 % 3 = 0)", "FALSE"),
    "stream_measures": f"""SELECT id_pdl, label, val, ts, date_debut, date_fin, fmt, uuid, misc,
      '{_NOW_SHOWN}' AS ingestion_ts FROM {cte(a.MEASURES)} {_LATEST}""",
    "stream_commands": fold(_GAS, final=True),
    "stream_suppress": _accept_spaced(),
    "stream_quarantine": f"""SELECT CASE WHEN row_errors = '' THEN 'valid' ELSE 'error' END AS kind,
      CASE WHEN row_errors = '' THEN id_pdl ELSE coalesce(id_pdl, '') END AS id_pdl,
      nullif(row_errors, '') AS detail FROM ({_with_row_errors()})""",
}
