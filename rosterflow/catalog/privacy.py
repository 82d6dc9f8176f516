"""Text-safety, masking and encryption queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterflow import constants as C
from rosterflow.catalog import views as V
from rosterflow.functions import dialogue, privacy
from rosterflow.functions import text as text_fn

KEY_NEW, KEY_OLD = "0123456789abcdef0123456789abcdef", "fedcba9876543210fedcba9876543210"


def pii(spark, sf):
    return V.view(spark, sf, V.PII)


def pii_lines(spark, sf):
    return V.view(spark, sf, V.PII_LINES, v_pii=pii(spark, sf))


def messages(spark, sf):
    return V.view(spark, sf, V.MESSAGES)


def documents(spark, sf):
    return V.table(spark, sf, "documents")


def tokenize(spark, sf):
    tokens = text_fn.tokenize(F.col("text"))
    return documents(spark, sf).select(
        "doc_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


def snippet(spark, sf):
    return documents(spark, sf).select("doc_id", text_fn.snippet(F.col("text")).alias("snippet"))


def mask_columns(spark, sf):
    table = pii(spark, sf)
    table = table.withColumn("logged_id", privacy.mask_id_in_log(F.col("id_card")))
    kinds = {"phone": "PHONE", "id_card": "ID_CARD", "name": "NAME", "email": "EMAIL",
             "address": "ADDRESS", "bank_card": "BANK_CARD"}
    one = F.when(F.col("c_mktsegment") == "BUILDING", "ADDRESS").otherwise("NAME")
    table = table.withColumn("by_kind", privacy.mask(F.col("address"), one))
    return privacy.mask_fields(table, kinds).select("c_custkey", *kinds, "logged_id", "by_kind")


def sanitize_text(spark, sf):
    lines = pii_lines(spark, sf).select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("line"))
    texts = documents(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("text").alias("line"))
    return lines.unionByName(texts).select("id", privacy.sanitize(F.col("line")).alias("line"))


def pii_scan(spark, sf):
    lines = pii_lines(spark, sf).select(F.lit("lines").alias("source"), F.col("line"))
    texts = documents(spark, sf).select("source", F.col("text").alias("line"))
    return lines.unionByName(texts).groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(privacy.contains_pii(F.col("line"))).alias("with_pii"))


def pii_placeholder(spark, sf):
    lines = pii_lines(spark, sf).select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("line"))
    asked = messages(spark, sf).select(F.concat(F.lit("m"), F.col("message_id")).alias("id"), F.col("message").alias("line"))
    return lines.unionByName(asked).select("id", privacy.mask_placeholders(F.col("line")).alias("line"))


def pii_dictionary(spark, sf):
    found = pii_lines(spark, sf).select("c_custkey", F.explode(privacy.placeholder_matches(F.col("line"))).alias("m"))
    return found.groupBy("c_custkey", "m.original").agg(F.min_by("m.placeholder", "m.rule").alias("placeholder"))


def _json_documents(spark, sf):
    nested = F.to_json(F.struct(
        F.col("c_custkey").alias("id"), F.struct("phone", "id_card").alias("contact"),
        F.array(F.struct(F.col("bank_card").alias("bankCard"), F.col("email"))).alias("cards"),
        F.col("address"), F.col("name").alias("studentName")))
    body = F.when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit("not json "), F.col("phone"))).otherwise(nested)
    return pii(spark, sf).select("c_custkey", body.alias("body"))


def mask_json(spark, sf):
    shape = StructType.fromDDL(
        "id bigint, contact struct<phone:string,id_card:string>, cards array<struct<bankCard:string,email:string>>, "
        "address string, studentName string")
    return _json_documents(spark, sf).select("c_custkey", privacy.mask_json_as(F.col("body"), shape).alias("body"))


def mask_json_any(spark, sf):
    return _json_documents(spark, sf).select("c_custkey", privacy.mask_json(F.col("body")).alias("body"))


def audit_params(spark, sf):
    calls = V.view(spark, sf, V.TOOL_CALLS)
    params = F.create_map(F.lit("student_id"), F.col("p_student_id"), F.lit("step_id"), F.col("p_step_id"))
    masked = privacy.mask_params(params)
    return calls.select("seq", masked["student_id"].alias("student_id"), masked["step_id"].alias("step_id"))


def sensitive_key_audit(spark, sf):
    kind = F.col("c_mktsegment")
    extra = F.when(kind == "BUILDING", "phone").when(kind == "HOUSEHOLD", "id_card").when(
        kind == "MACHINERY", "scope").otherwise("role")
    claims = F.create_map(F.lit("student_id"), F.col("c_custkey").cast("string"), extra, F.col("phone"))
    return pii(spark, sf).select("c_custkey", privacy.forbidden_claims(claims).alias("sensitive"))


def chat_request_valid(spark, sf):
    return messages(spark, sf).select(
        "message_id", text_fn.message_is_valid(F.col("student_id"), F.col("message")).alias("valid"))


def safety_verdict(spark, sf):
    asked = messages(spark, sf).select(F.concat(F.lit("m"), F.col("message_id")).alias("id"), "message")
    texts = documents(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("text").alias("message"))
    judged = asked.unionByName(texts).withColumn("category", dialogue.safety_category(F.col("message")))
    return judged.select(
        "id", "category", F.col("category").isNotNull().alias("blocked"),
        dialogue.refusal_text(F.col("category")).alias("reply"),
        F.coalesce(F.col("category") == "self_harm", F.lit(False)).alias("transfer_to_human"))


def encrypt_roundtrip(spark, sf):
    key = F.lit(KEY_NEW)
    stored = pii(spark, sf).withColumn("cipher", privacy.encrypt(F.col("id_card"), key))
    return stored.select(
        "c_custkey", privacy.decrypt(F.col("cipher"), [key]).alias("id_card"),
        F.length(F.unbase64("cipher")).alias("n_bytes"))


def rekey_roundtrip(spark, sf):
    new, old = F.lit(KEY_NEW), F.lit(KEY_OLD)
    mixed = F.when(F.col("c_mktsegment") == "BUILDING", privacy.encrypt(F.col("phone"), old)).when(
        F.col("c_mktsegment") == "HOUSEHOLD", privacy.encrypt(F.col("phone"), F.lit("x" * 32))).otherwise(
        privacy.encrypt(F.col("phone"), new))
    opened = pii(spark, sf).withColumn("plain", privacy.decrypt(mixed, [new, old]))
    again = opened.withColumn("cipher", privacy.encrypt(F.col("plain"), new))
    return again.select("c_custkey", privacy.decrypt(F.col("cipher"), [new]).alias("phone"),
                        F.col("plain").isNull().alias("quarantined"))


QUERIES = {fn.__name__: fn for fn in (
    tokenize, snippet, mask_columns, sanitize_text, pii_scan, pii_placeholder, pii_dictionary, mask_json, mask_json_any, audit_params,
    sensitive_key_audit, chat_request_valid, safety_verdict, encrypt_roundtrip, rekey_roundtrip)}


def _keep_ends_sql(col, head, tail):
    return (f"case when length({col}) < 9 then repeat('*', length({col})) else substr({col}, 1, {head}) || "
            f"repeat('*', length({col}) - {head + tail}) || right({col}, {tail}) end")


def _name_sql(col):
    return (f"case when length({col}) = 0 then {col} when length({col}) = 1 then '*' when length({col}) = 2 then substr({col}, 1, 1) || '*' "
            f"else substr({col}, 1, 1) || repeat('*', length({col}) - 2) || right({col}, 1) end")


def _address_sql(col):
    ends = ", ".join(
        f"case when instr({col}, '{s}') > 0 then instr({col}, '{s}') + {len(s)} - 1 else 0 end" for s in C.DISTRICT_SUFFIXES)
    cut = f"greatest({ends})"
    return (f"case when trim({col}) = '' then {col} when {cut} > 0 and {cut} < length({col}) then substr({col}, 1, {cut}) || '***' "
            f"when length({col}) > 6 then substr({col}, 1, 6) || '***' else repeat('*', length({col})) end")


def _replace(expr, pattern, to):
    return f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"


def _bounded(expr, pattern, to, times=2):
    """Replacement between non-digits without look-around; twice, since the borders are consumed."""
    for _ in range(times):
        expr = _replace(expr, f"(^|[^0-9]){pattern}([^0-9]|$)", to)
    return expr


def _sanitize_sql(col):
    out = _bounded(col, r"([1-9][0-9]{2})[0-9]{11}([0-9]{3}[0-9Xx])", r"\1\2***********\3\4")
    out = _bounded(out, r"(1[3-9][0-9])[0-9]{4}([0-9]{4})", r"\1\2****\3\4")
    out = _replace(out, r"([a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]+@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", r"\1***@\2")
    out = _replace(out, r"(^|[^a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", r"\1*@\2")
    for n in range(7, 12):
        out = _bounded(out, r"([62][0-9]{3})[0-9]{%d}([0-9]{4})" % n, r"\1\2" + "*" * n + r"\3\4")
    return out


def _placeholder_sql(col):
    out = col
    for _ in range(2):
        out = _replace(out, r"(^|[^0-9A-Za-z_])([0-9]{16,17}|[0-9]{19})([^0-9A-Za-z_]|$)", r"\1[CARD]\3")
    out = _replace(out, "[0-9]{17}[0-9Xx]", "[ID]")
    out = _replace(out, "1[3-9][0-9]{9}", "[PHONE]")
    for _ in range(2):
        out = _replace(out, r"STU[0-9]+|(^|[^0-9A-Za-z_])[0-9]{8}([^0-9A-Za-z_]|$)", r"\1[STUDENT_NO]\2")
    return out


SNIPPET_SQL = """case when {0} is null then '' when length(regexp_replace(regexp_replace({0}, '[0-9]{{18}}', '[ID]', 'g'), '1[3-9][0-9]{{9}}', '[PHONE]', 'g')) > 120
  then substr(regexp_replace(regexp_replace({0}, '[0-9]{{18}}', '[ID]', 'g'), '1[3-9][0-9]{{9}}', '[PHONE]', 'g'), 1, 120) || '...'
  else regexp_replace(regexp_replace({0}, '[0-9]{{18}}', '[ID]', 'g'), '1[3-9][0-9]{{9}}', '[PHONE]', 'g') end"""
TOKENS_SQL = r"regexp_extract_all(lower({0}), '[a-z0-9]+|[\p{{L}}\p{{Nd}}]')"


def safety_sql(col):
    whens = [f"when regexp_matches({col}, '{p}') then '{category}'" for category, patterns, _ in C.SAFETY_RULES for p in patterns]
    return f"case when trim({col}) = '' then null " + " ".join(whens) + " end"


_REFUSAL = "case category " + " ".join(f"when '{c}' then '{t}'" for c, _, t in C.SAFETY_RULES) + " end"
_L = dict(v_pii=V.PII, v_lines=V.PII_LINES)

ORACLES = {
    "tokenize": f"select doc_id, len(t) as n_tokens, array_to_string(t, ' ') as tokens from (select doc_id, {TOKENS_SQL.format('text')} as t from documents) d",
    "snippet": f"select doc_id, {SNIPPET_SQL.format('text')} as snippet from documents",
    "mask_columns": V.oracle(f"""
      select c_custkey, {_keep_ends_sql('phone', 3, 4)} as phone, {_keep_ends_sql('id_card', 3, 4)} as id_card,
        {_name_sql('name')} as name, case when instr(email, '@') <= 1 or instr(email, '@') = length(email) then repeat('*', length(email))
          when instr(email, '@') = 2 then '*' || substr(email, 2)
          else substr(email, 1, 1) || '***' || substr(email, instr(email, '@')) end as email,
        {_address_sql('address')} as address, {_keep_ends_sql('bank_card', 4, 4)} as bank_card,
        regexp_replace(id_card, '([0-9]{{3}})[0-9]*([0-9]{{4}})', '\\1***********\\2', 'g') as logged_id,
        case when c_mktsegment = 'BUILDING' then {_address_sql('address')}
          when trim(address) = '' then address else {_name_sql('address')} end as by_kind
      from v_pii""", v_pii=V.PII),
    "sanitize_text": V.oracle(f"""
      select 'c' || cast(c_custkey as string) as id, {_sanitize_sql('line')} as line from v_lines
      union all select 'd' || cast(doc_id as string), {_sanitize_sql('text')} from documents""", **_L),
    "pii_scan": V.oracle(r"""
      , all_texts as (select 'lines' as source, line from v_lines union all select source, text from documents)
      select source, count(*) as texts, count(*) filter (
        regexp_matches(line, '(^|[^0-9])[1-9][0-9]{16}[0-9Xx]([^0-9]|$)') or regexp_matches(line, '(^|[^0-9])1[3-9][0-9]{9}([^0-9]|$)')
        or regexp_matches(line, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')
        or regexp_matches(line, '(^|[^0-9])[62][0-9]{14,18}([^0-9]|$)')) as with_pii from all_texts group by source""", **_L),
    "pii_placeholder": V.oracle(f"""
      select 'c' || cast(c_custkey as string) as id, {_placeholder_sql('line')} as line from v_lines
      union all select 'm' || cast(message_id as string), {_placeholder_sql('message')} from v_messages""", **_L, v_messages=V.MESSAGES),
    "pii_dictionary": V.oracle("""
      select distinct c_custkey, original, placeholder from (
        select c_custkey, bank_card as original, '[CARD]' as placeholder from v_pii
        union all select c_custkey, id_card, '[ID]' from v_pii
        union all select c_custkey, phone, '[PHONE]' from v_pii
        union all select c_custkey, '2026' || lpad(cast(c_custkey % 10000 as string), 4, '0'), '[STUDENT_NO]' from v_pii
        union all select c_custkey, 'STU' || cast(c_custkey as string), '[STUDENT_NO]' from v_pii) t""", v_pii=V.PII),
    "mask_json": V.oracle(f"""
      select c_custkey, case when c_mktsegment = 'FURNITURE' then 'not json ' || phone else
        '{{"id":' || cast(c_custkey as string) || ',"contact":{{"phone":"' || {_keep_ends_sql('phone', 3, 4)} || '","id_card":"' || {_keep_ends_sql('id_card', 3, 4)}
        || '"}},"cards":[{{"bankCard":"' || {_keep_ends_sql('bank_card', 4, 4)} || '","email":"' ||
        case when instr(email, '@') <= 1 then repeat('*', length(email)) when instr(email, '@') = 2 then '*' || substr(email, 2)
          else substr(email, 1, 1) || '***' || substr(email, instr(email, '@')) end
        || '"}}],"address":"' || {_address_sql('address')} || '","studentName":"' || {_name_sql('name')} || '"}}' end as body
      from v_pii""", v_pii=V.PII),
    "audit_params": V.oracle("""
      select seq, case when length(p_student_id) > 4 then '****' || right(p_student_id, 4)
        when p_student_id is not null then '****' end as student_id, p_step_id as step_id from v_calls""", v_calls=V.TOOL_CALLS),
    "sensitive_key_audit": "select c_custkey, c_mktsegment in ('BUILDING', 'HOUSEHOLD') as sensitive from customer",
    "chat_request_valid": V.oracle("select message_id, trim(message) <> '' and length(message) <= 500 as valid from v_messages", v_messages=V.MESSAGES),
    "safety_verdict": V.oracle(f"""
      , judged as (select 'm' || cast(message_id as string) as id, {safety_sql('message')} as category from v_messages
        union all select 'd' || cast(doc_id as string), {safety_sql('text')} from documents)
      select id, category, category is not null as blocked, {_REFUSAL} as reply, coalesce(category = 'self_harm', false) as transfer_to_human
      from judged""", v_messages=V.MESSAGES),
    "encrypt_roundtrip": V.oracle("select c_custkey, id_card, cast(12 + length(id_card) + 16 as int) as n_bytes from v_pii", v_pii=V.PII),
    "rekey_roundtrip": V.oracle("""
      select c_custkey, case when c_mktsegment <> 'HOUSEHOLD' then phone end as phone, c_mktsegment = 'HOUSEHOLD' as quarantined
      from v_pii""", v_pii=V.PII),
}
ORACLES["mask_json_any"] = ORACLES["mask_json"]
