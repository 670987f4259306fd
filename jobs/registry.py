"""The jobs as queries, and their DuckDB SQL."""

import json

from skyframe import queries as image
from skyframe.config import DetectConfig

from . import sky_catalog, text_survey
from .common import beside, settings


def _survey_sql() -> str:
    c = settings(text_survey.DEFAULTS, beside(text_survey.__file__))
    block, longest = c["block"], c["longest"]
    raw = f"""SELECT brick, row, col, CAST(count(*) AS DOUBLE) AS v FROM (SELECT brick, row, least(length(word), {longest}) - 1 AS col
        FROM (SELECT coalesce(nullif(source, ''), '(none)') AS brick, doc_id // {block} AS row, unnest(string_split_regex(text, '[\\x20\\x09-\\x0D]+')) AS word FROM documents WHERE doc_id >= 0) WHERE word <> '') GROUP BY ALL"""
    ctes = image._ctes(raw, "(SELECT max(row) + 1 FROM raw)", longest, c["mesh"], DetectConfig(c["sigma"], c["thresh"], c["minarea"]))
    return image._with(
        f"""SELECT brick AS source, label, npix, CAST(rmin * {block} AS BIGINT) AS first_doc, CAST((rmax + 1) * {block} - 1 AS BIGINT) AS last_doc, cmin + 1 AS shortest, cmax + 1 AS longest,
        CAST(peak_row * {block} AS BIGINT) AS peak_doc, peak_col + 1 AS peak_length, {image._cols('peak_snr')} FROM det""",
        ctes,
    )


def _catalog_sql() -> str:
    c = settings(sky_catalog.DEFAULTS, beside(sky_catalog.__file__))
    assert c["tolerance_arcsec"] == 1.0, "the SQL has a tolerance of one second of arc"
    return image._dedup_sql(c["same_brick"], f"SELECT id, brick, {image._cols('ra', 'dec', digits=7)}, npix, CAST(floor(dec / {json.dumps(c['zone_degrees'])}e0) AS INT) AS zone, id IN (SELECT id FROM bad) AS gone FROM sky")


QUERIES = {"job1_text_survey": text_survey.job1_text_survey, "job2_sky_catalog": sky_catalog.job2_sky_catalog}
ORACLES = {"job1_text_survey": _survey_sql(), "job2_sky_catalog": _catalog_sql()}
