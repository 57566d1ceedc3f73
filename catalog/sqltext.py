"""DuckDB fragments shared by the oracle texts."""

from catalog.views import CUT_SQL as CUT


def words(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


CLOSED3 = "('finalizado','completado','cerrado')"
CLOSED4 = "('finalizado','completado','cerrado','archivado')"
SUSP3 = "('en suspensión','en suspension','stand-by')"
LATE_OUT = "('finalizado','completado','cerrado','archivado','en suspensión','en suspension','stand-by')"
HIGH5 = "('alto','alta','high','crítico','critico')"
HIGH7 = "('alto','alta','high','crítico','critico','crítica','critica')"
MED3 = "('medio','media','medium')"
LOW3 = "('bajo','baja','low')"
FINISHED = ("('finalizado','finalizada','completado','completada','cerrado','cerrada','implementado',"
            "'implementada','archivada')")


def date(c: str) -> str:
    s = f"substr(split_part(trim({c}), 'T', 1), 1, 10)"
    return (f"(CASE WHEN regexp_full_match({s}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(try_strptime({s}, '%Y-%m-%d') AS DATE) "
            f"WHEN regexp_full_match({s}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(try_strptime({s}, '%d/%m/%Y') AS DATE) END)")


def norm_status(c: str) -> str:
    s = f"lower(trim(coalesce({c}, '')))"
    return (f"(CASE WHEN {s} LIKE '%validación%' OR {s} LIKE '%validacion%' THEN 'Pendiente de validación' "
            f"WHEN {s} IN {FINISHED} THEN 'Finalizado' "
            f"WHEN {s} IN ('en suspensión','en suspension','stand-by','suspendida','suspendido') THEN 'En suspensión' "
            f"ELSE 'En proceso' END)")


def norm_severity(c: str) -> str:
    s = f"lower(trim(coalesce({c}, '')))"
    return (f"(CASE WHEN {s} IN ('alto','alta','high','crítico','critico','crítica','critica','elevado','elevada') THEN 'Alto' "
            f"WHEN {s} IN ('bajo','baja','low','leve','menor') THEN 'Bajo' ELSE 'Medio' END)")


def effective(status: str, dt: str) -> str:
    n = norm_status(status)
    return f"(CASE WHEN {n} = 'En proceso' AND {dt} < {CUT} THEN 'Vencido' ELSE {n} END)"


def client(status: str, dt: str) -> str:
    s = f"lower(trim(coalesce(nullif({status}, ''), 'En proceso')))"
    return (f"(CASE WHEN {s} IN {FINISHED} THEN 'Finalizado' WHEN {s} IN {SUSP3} THEN 'En suspensión' "
            f"WHEN {s} LIKE '%pendiente de validaci_n%' OR {s} = 'pendiente validacion' THEN 'Pendiente de validación' "
            f"WHEN {dt} < {CUT} THEN 'Vencido' ELSE 'En proceso' END)")


def export(status: str, dt: str) -> str:
    s = f"lower({status})"
    return (f"(CASE WHEN regexp_matches({s}, 'finalizado|finalizada|completada|completado|implementada|archivada') THEN 'Finalizado' "
            f"WHEN regexp_matches({s}, 'suspensión|suspension|stand-by') THEN 'En suspensión' "
            f"WHEN {dt} < {CUT} THEN 'Vencido' ELSE 'En proceso' END)")


def clean(c: str) -> str:
    return f"trim(regexp_replace({c}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"


def norm_text(c: str) -> str:
    return f"lower({clean(f'strip_accents(coalesce({c}, {chr(39)*2}))')})"


def norm_key(c: str) -> str:
    return (f"trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce({c}, '')), '[^\\x00-\\x7F]+', '', 'g')), "
            f"'[^a-z0-9]+', ' ', 'g'))")


# The reference's four-way joins, as they are written there.
INNER4 = """action_plans pa JOIN proposals p ON pa.proposal_id = p.id
  JOIN findings f ON p.finding_id = f.id JOIN reports r ON f.report_id = r.id"""
PROPS3 = "proposals p JOIN findings f ON p.finding_id = f.id JOIN reports r ON f.report_id = r.id"
LEFT4 = """findings f JOIN reports r ON f.report_id = r.id LEFT JOIN proposals p ON p.finding_id = f.id
  LEFT JOIN action_plans pa ON pa.proposal_id = p.id"""
ALL4 = """reports r LEFT JOIN findings f ON f.report_id = r.id LEFT JOIN proposals p ON p.finding_id = f.id
  LEFT JOIN action_plans pa ON pa.proposal_id = p.id"""
