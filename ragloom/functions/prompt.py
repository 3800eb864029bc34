"""prompt augmentation from retrieved examples, written with array functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: scene keywords, searched as substrings of the lower-cased description, in this order
SCENE_KEYWORDS = ["indoor", "outdoor", "kitchen", "living room", "park", "street", "garden"]
MAX_SCENES = 2
MAX_OBJECTS = 3
FALLBACK_STYLE = "in realistic style"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def augment_prompt(query, examples, description_field: str = "description", tags_field: str = "tags") -> Column:
    """Augmented prompt for ``query`` from ``examples`` (array<struct<description, tags>> in rank order).

    * no examples -> the query unchanged;
    * scenes: keywords found in each description, in example then keyword order, first
      appearance kept; the first two give 'in a, b setting';
    * objects: all tags in order, first appearance kept; of the first three, those whose
      lower-case form occurs in the lower-cased query are dropped; the rest give 'with x, y';
    * neither part -> 'in realistic style'. Parts are joined by ', '.
    """
    q = _c(query)
    ex = _c(examples)
    empty = F.array().cast("array<string>")
    kws = F.array(*[F.lit(k) for k in SCENE_KEYWORDS])
    scenes = F.coalesce(F.array_distinct(F.flatten(F.transform(
        ex, lambda e: F.filter(kws, lambda k: F.coalesce(F.lower(e[description_field]).contains(k), F.lit(False)))))),
        empty)
    objects = F.coalesce(F.array_distinct(F.flatten(F.transform(
        ex, lambda e: F.coalesce(e[tags_field], empty)))), empty)
    new_objects = F.filter(F.slice(objects, 1, MAX_OBJECTS), lambda o: ~F.lower(q).contains(F.lower(o)))
    scene_part = F.when(F.size(scenes) > 0,
                        F.concat(F.lit("in "), F.array_join(F.slice(scenes, 1, MAX_SCENES), ", "), F.lit(" setting")))
    object_part = F.when(F.size(new_objects) > 0, F.concat(F.lit("with "), F.array_join(new_objects, ", ")))
    return (F.when(ex.isNull() | (F.size(ex) == 0), q)
             .when(scene_part.isNull() & object_part.isNull(), F.concat_ws(", ", q, F.lit(FALLBACK_STYLE)))
             .otherwise(F.concat_ws(", ", q, scene_part, object_part)))
