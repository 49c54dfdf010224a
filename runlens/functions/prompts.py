"""Prompt text, model and dataset names, image references and object paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed lookup: dataset name -> short subset name.
DATASET_ALIASES = {
    "princeton-nlp/SWE-Bench": "full",
    "princeton-nlp/SWE-bench": "full",
    "princeton-nlp/SWE-Bench_Verified": "verified",
    "princeton-nlp/SWE-bench_Verified": "verified",
    "princeton-nlp/SWE-Bench_Lite": "lite",
    "princeton-nlp/SWE-bench_Lite": "lite",
    "SWE-bench/SWE-bench_Lite": "lite",
    "SWE-bench/SWE-bench_Verified": "verified",
    "SWE-bench/SWE-Bench_Verified": "verified",
    "princeton-nlp/SWE-Bench_Multimodal": "multimodal",
    "swe-bench/SWE-Bench_Multilingual": "multilingual",
    "SWE-bench/SWE-smith": "smith",
    "nebius/SWE-rebench": "rebench",
}
TEST_SPLIT_DATASET = "princeton-nlp/SWE-bench_Verified"
IMAGE_PREFIX = "sweb.eval.x86_64."

CHAT_TEMPLATE = "<|im_start|>user\n{content}<|im_end|>\n<|im_start|>assistant\n"


def render_template(template: Column | str, values: dict[str, Column]) -> Column:
    """Replace each `{key}` in turn; unknown keys stay as they are.

    Replacement is sequential, so a value that holds `{other}` is filled in by
    a later key: the order of `values` matters.
    """
    text = F.lit(template) if isinstance(template, str) else template
    for key, value in values.items():
        text = F.replace(text, F.lit(f"{{{key}}}"), value.cast("string"))
    return text


def build_chat_prompt(problem: Column, template: str = CHAT_TEMPLATE) -> Column:
    """One user message in the model's chat markup, ready for generation."""
    before, after = template.split("{content}", 1)
    return F.concat(F.lit(before), problem, F.lit(after))


def split_system_user(prompt: Column) -> Column:
    """Chat messages of a stored prompt: first line system, the rest user."""
    parts = F.split(prompt, "\n", 2)

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.when(
        F.size(parts) == 2,
        F.array(
            message("system", F.get(parts, F.lit(0))),
            message("user", F.get(parts, F.lit(1))),
        ),
    ).otherwise(F.array(message("user", prompt)))


def model_slug(name: Column) -> Column:
    """File-safe model name: second path piece if there is one, lower case."""
    pieces = F.split(name, "/", -1)
    piece = F.coalesce(F.get(pieces, F.lit(1)), F.get(pieces, F.lit(0)))
    return F.replace(F.lower(piece), F.lit("."), F.lit("-"))


def rewrite_image_ref(image: Column, registry: str) -> Column:
    """Image in the internal registry: namespace dropped, `:latest` becomes `:v1`."""
    slash = F.position(F.lit("/"), image)
    name = F.when(slash > 0, F.substr(image, slash + 1)).otherwise(F.lit(""))
    return F.concat(F.lit(f"{registry}/"), retag(name))


def retag(name: Column) -> Column:
    return F.regexp_replace(name, F.lit(r":latest\z"), F.lit(":v1"))


def image_repo_key(image: Column, prefix: str = IMAGE_PREFIX) -> Column:
    """Summary key of an image: namespace, tag and the fixed prefix removed."""
    slash = F.position(F.lit("/"), image)
    name = F.when(slash > 0, F.substr(image, slash + 1)).otherwise(image)
    untagged = F.regexp_replace(name, F.lit(r"(?s):[^:]*\z"), F.lit(""))
    at = F.position(F.lit(prefix), untagged)
    return F.when(at > 0, F.substr(untagged, at + len(prefix))).otherwise(untagged)


def dataset_alias(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Short subset name, the name itself when it has none."""
    table = DATASET_ALIASES if aliases is None else aliases
    entries = F.create_map(*[F.lit(item) for pair in table.items() for item in pair])
    return F.coalesce(F.try_element_at(entries, name), name)


def default_split(name: Column) -> Column:
    return F.when(name == TEST_SPLIT_DATASET, F.lit("test")).otherwise(F.lit("train"))


def split_object_path(uri: Column) -> Column:
    """struct(bucket, key) of an s3 URI; any other scheme fails the job."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(uri, F.lit(r"^[A-Za-z0-9+.-]+:"), F.lit(""))
    path = F.regexp_replace(rest, F.lit(r"(?s)[?#].*\z"), F.lit(""))
    hosted = F.startswith(path, F.lit("//"))
    pieces = F.split(F.substr(path, F.lit(3)), "/", 2)
    bucket = F.when(hosted, F.get(pieces, F.lit(0))).otherwise(F.lit(""))
    key = F.when(hosted, F.coalesce(F.get(pieces, F.lit(1)), F.lit(""))).otherwise(path)
    return F.struct(
        F.when(scheme == "s3", bucket)
        .otherwise(F.raise_error(F.concat(F.lit("only s3 paths can be split into bucket and key, this is: "), uri)))
        .cast("string")
        .alias("bucket"),
        F.ltrim(key, F.lit("/")).alias("key"),
    )
