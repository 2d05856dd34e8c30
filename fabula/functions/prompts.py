"""Prompt texts and answers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions.text import trim_ws, unicode_normalize

#: Fixed value: how a request may begin before it names a style.
STYLE_PREAMBLE = r"(?iu)^\s*(в\s+стиле|style\s+of|in\s+the\s+style\s+of)\s+"
#: Fixed value: a place in a template that a value fills.
PLACE = r"\{\{\s*([a-zA-Z0-9_.-]+)\s*\}\}"


def render(template: str, **values: Column) -> Column:
    """``{{ key }}`` replaced by the values, in one pass: what a value holds is never filled. Keys
    without a value, and values that are null in a row, leave their place as it is."""
    parts, at = [], 0
    for place in re.finditer(PLACE, template):
        parts.append(F.lit(template[at : place.start()]))
        value = values.get(place[1])
        parts.append(F.lit(place[0]) if value is None else F.coalesce(value.cast("string"), F.lit(place[0])))
        at = place.end()
    return F.concat(*parts, F.lit(template[at:]))


def render_rows(template: Column, values: Column) -> Column:
    """The template of each row filled from its map of values, in one pass as render() does; null
    for a null template, and without values the template itself."""
    known = F.coalesce(values, F.create_map().cast("map<string,string>"))
    filled = F.zip_with(F.regexp_extract_all(template, F.lit(PLACE), F.lit(0)), F.regexp_extract_all(template, F.lit(PLACE), F.lit(1)), lambda place, key: F.coalesce(F.element_at(known, key), place))
    parts = F.zip_with(F.split(template, PLACE, -1), filled, lambda text, value: F.concat(text, F.coalesce(value, F.lit(""))))
    return F.array_join(parts, "")


def lines(*parts: Column) -> Column:
    """The parts that are not null or empty, one on each line."""
    return F.concat_ws("\n", *(F.when(p != "", p) for p in parts))


def described(name: Column, **values: Column) -> Column:
    """One line about an entity: its name and those values that are known."""
    known = (F.when(v != "", F.concat(F.lit(f"{k}="), v)) for k, v in values.items())
    return F.concat_ws("; ", F.concat(F.lit("- "), name), *known)


def section(title: str, entries: Column) -> Column:
    """A title over the lines of an array; null without any."""
    return F.when(F.size(entries) > 0, F.concat_ws("\n", F.lit(title), F.array_join(entries, "\n")))


def titled(title: str, value: Column) -> Column:
    """``title: value``; null where there is no value."""
    return F.when(value.cast("string") != "", F.concat(F.lit(f"{title}: "), value.cast("string")))


def chain(names: Column) -> Column:
    """Names from the outermost on; null where there is only one."""
    return F.when(F.size(names) > 1, F.array_join(names, " > "))


def find_prompts(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """Wanted (request, id, version) with the first entry of the registry (position, id,
    version, template) of that id and, if one is asked for, that version."""
    r = registry.select("id", F.col("version").alias("_version"), "position", "template")
    fits = wanted.join(r, "id").where(F.col("version").isNull() | (F.col("version") == F.col("_version")))
    found = fits.groupBy("request").agg(F.min_by(F.struct("_version", "template"), "position").alias("x"))
    return found.select("request", F.col("x._version").alias("version"), "x.template")


def unwrap_json(answer: Column) -> Column:
    """What a fenced block of an answer holds, or the whole answer, without white space around."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return trim_ws(F.when(fenced != "", fenced).otherwise(answer))


def answer_text(response: Column) -> Column:
    """The text of a model's JSON response, wherever its form has it: alone, in the first
    choice, or in the parts of all outputs one after the other."""
    parts = F.from_json(response, "struct<output:array<struct<content:array<struct<text:string>>>>>")["output"]
    texts = F.filter(F.flatten(F.transform(F.filter(parts, lambda o: o["content"].isNotNull()), lambda o: F.transform(o["content"], lambda c: c["text"]))), lambda t: t.isNotNull())
    paths = ("$.output_text", "$.choices[0].message.content")
    return F.coalesce(*(F.get_json_object(response, p) for p in paths), F.when(F.size(texts) > 0, F.array_join(texts, "")))


def request_fingerprint(prompt: Column) -> Column:
    """Length and SHA-256 of a prompt, for logs that must not have the prompt."""
    return F.struct(F.length(prompt).alias("n_chars"), F.sha2(prompt, 256).alias("sha256"))


def abstract_styles(requests: DataFrame, presets: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, style, subject, avoided): the first preset by rank of which a trigger is in the request,
    or null; the request without its preamble; and the references that a prompt should avoid, which are
    all triggers of the preset, or else the subject. ``presets`` has (rank, style, trigger), triggers in
    lower case; it is a small dimension, and goes to every task only if Spark finds it small."""
    text = unicode_normalize(F.lower(trim_ws(F.col(text_col))), "NFKC")
    hits = requests.select(id_col, text.alias("_t")).join(presets, F.col("_t").contains(F.col("trigger")))
    first = hits.groupBy(id_col).agg(F.min_by("style", F.struct("rank", "style")).alias("style"))
    triggers = presets.groupBy("style").agg(F.sort_array(F.collect_set("trigger")).alias("_triggers"))
    subject = trim_ws(F.regexp_replace(trim_ws(F.col(text_col)), STYLE_PREAMBLE, ""))
    rows = requests.select(id_col, subject.alias("subject")).join(first, id_col, "left").join(triggers, "style", "left")
    return rows.select(id_col, "style", "subject", F.coalesce("_triggers", F.filter(F.array("subject"), lambda x: x != "")).alias("avoided"))


#: What every scene and passport prompt says.
SCENE_TASK = "Generate one production illustration from the resolved world bible context."
SCENE_RULES = (
    "Preserve identity, age, clothing, architecture, spatial hierarchy, and era from the references.",
    "Do not invent new named characters or locations unless the user request explicitly asks for them.",
)
SCENE_AVOIDS = "wrong character identity, inconsistent costume, inconsistent location layout, mismatched era, extra named characters, text, watermark, logo"
PASSPORT_RULES = (
    "Maintain exact character identity across all generated passport assets.",
    "Use a clean reference-sheet composition suitable as future scene generation reference.",
)
PASSPORT_AVOIDS = "inconsistent identity, different facial structure, extra limbs, unreadable silhouette, text labels, watermark, logo, cropped reference sheet"
#: The fields of entities in prompts and what they are called there.
CHARACTER_FIELDS = {"age": "age", "appearance": "appearance", "personality": "personality", "speech": "speech_manner", "clothing": "clothing", "visual": "visual_prompt"}
LOCATION_FIELDS = {"description": "description", "atmosphere": "atmosphere", "palette": "palette", "era": "era", "lighting": "lighting_rules", "architecture": "architecture_rules", "recurringObjects": "recurring_objects"}
OBJECT_FIELDS = {"description": "description", "visual": "visual_prompt", "metadata": "metadata"}
ASSET_FIELDS = {"assetId": "id", "path": "local_path", "mime": "mime_type", "referencePrompt": "prompt"}
PASSPORT_FIELDS = {"Appearance": "appearance", "Clothing": "clothing", "Personality cues": "personality", "Speech manner cue": "speech_manner", "Timeline range": "timeline_range", "Character art direction": "visual_prompt"}
STYLE_COLORS = {"Primary color": "primary_color", "Secondary color": "secondary_color", "Accent color": "accent_color"}
STYLE_LEVELS = {"Contrast level": "contrast_level", "Saturation level": "saturation_level", "Grain level": "grain_level", "Line thickness": "line_thickness"}


def _style(style: Column) -> list[Column]:
    """Name, language and controls of a style; a level of 0 is one, a color without a value none."""
    levels = (F.concat(F.lit(f"{k}: "), style[c].cast("string"), F.lit("/100")) for k, c in STYLE_LEVELS.items())
    return [titled("Visual style", style["name"]), titled("Style language", style["prompt"]), *(titled(k, style[c]) for k, c in STYLE_COLORS.items()), *levels]


def _entities(title: str, rows: Column, fields: dict[str, str], aliases: bool = True) -> Column:
    """One line for each entity of an array; ``rows`` has name, aliases and the fields, as text."""

    def line(x: Column) -> Column:
        also = {"aliases": F.array_join(x["aliases"], ", ")} if aliases else {}
        return described(x["name"], **also, **{k: x[c] for k, c in fields.items()})

    return section(title, F.transform(rows, line))


def scene_prompt(request: Column, characters: Column, locations: Column, objects: Column, graph_lines: Column, assets: Column, style: Column) -> Column:
    """A struct of prompt and negative_prompt. ``request`` has user_text, timeline_hint and aspect_ratio;
    entities are arrays of structs with name, aliases and the fields named above (as text, structures as
    JSON), assets of structs with entity_type, entity_id and theirs; ``graph_lines`` is an array. What is
    null or empty leaves no line."""
    listed = F.transform(assets, lambda a: described(F.concat_ws(":", a["entity_type"], a["entity_id"]), **{k: a[c] for k, c in ASSET_FIELDS.items()}))
    prompt = lines(
        F.lit(SCENE_TASK),
        F.concat(F.lit("User scene request: "), request["user_text"]),
        titled("Timeline hint", request["timeline_hint"]),
        titled("Aspect ratio", request["aspect_ratio"]),
        _entities("Resolved characters:", characters, CHARACTER_FIELDS),
        _entities("Resolved locations:", locations, LOCATION_FIELDS),
        _entities("Resolved objects:", objects, OBJECT_FIELDS, aliases=False),
        section("Knowledge graph context:", graph_lines),
        section("Approved reference assets:", listed),
        *_style(style),
        *map(F.lit, SCENE_RULES),
    )
    return F.struct(prompt.alias("prompt"), _avoided(style, F.lit(SCENE_AVOIDS)).alias("negative_prompt"))


def _avoided(style: Column, *others: Column) -> Column:
    return F.concat_ws(", ", *(F.when(x != "", x) for x in (style["negative_prompt"], *others)))


def passport_prompt(asset_type: Column, layout: Column, name: Column, version: Column, style: Column, seed: Column) -> Column:
    """A struct of prompt and negative_prompt for one sheet of a character. ``layout`` tells what the kind of sheet
    shows; ``version`` has version, age, negative_prompt and the fields named above."""
    prompt = lines(
        F.concat(F.lit("Character visual passport asset: "), asset_type),
        F.concat(F.lit("Character: "), name),
        titled("Version", version["version"]),
        titled("Age", version["age"]),
        titled("Asset layout", layout),
        *(titled(k, version[c]) for k, c in PASSPORT_FIELDS.items()),
        *_style(style),
        titled("Seed", seed),
        *map(F.lit, PASSPORT_RULES),
    )
    return F.struct(prompt.alias("prompt"), _avoided(style, version["negative_prompt"], F.lit(PASSPORT_AVOIDS)).alias("negative_prompt"))
