"""Prompts as projections to array<struct<role, content>>.

Each builder exposes exactly the inputs that its step may see: a query never
shows its own answer, demonstrations show theirs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palatine.functions.normalize import first_truthy
from palatine.functions.parse import joined

#: Directions for three single hypotheses when one reply cannot hold all three.
ANGLES = (
    "Favour compounds typical of the food's category.",
    "Favour compounds formed along with the known ones.",
    "Favour compounds the evidence and examples name.",
)


def messages(system: str, user: Column) -> Column:
    """A system and a user message."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(one("system", F.lit(system)), one("user", user))


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def _json(items: Column) -> Column:
    return F.to_json(F.coalesce(items, F.array().cast("array<string>")))


FOOD_RULE = 'Answer with one JSON object: {"predicted_food": "<name>"}.'
MOLECULE_RULE = 'Answer with one JSON object: {"predicted_molecules": ["<name>", ...]}.'
THREE_FOODS = 'Answer with one JSON object: {"hypotheses": [{"predicted_food": "<name>", "rationale": "<text>"}, ...]} holding exactly three.'
THREE_SETS = 'Answer with one JSON object: {"hypotheses": [{"predicted_molecules": ["<name>", ...], "rationale": "<text>"}, ...]} holding exactly three.'
CHOICE = 'Answer with one JSON object: {"selected_hypothesis_index": <1, 2 or 3>, "review_reason": "<text>"}.'


def food_prompt(molecules: Column) -> Column:
    return messages("You name the one food that a set of flavour molecules belongs to.", _lines(_labelled("Molecules", _json(molecules)), FOOD_RULE))


def molecules_prompt(food: Column, partial: Column, n: Column) -> Column:
    ask = F.concat(F.lit("Name exactly "), n.cast("string"), F.lit(" further molecules, none of the known ones."))
    return messages("You complete the flavour molecules of a food.", _lines(_labelled("Food", first_truthy(food)), _labelled("Known molecules", _json(partial)), ask, MOLECULE_RULE))


def food_demos(demos: Column) -> Column:
    """A numbered block of demonstrations array<struct<molecules, actual_food>>."""
    return F.array_join(F.transform(demos, lambda d, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit("\nMolecules: "), joined(d["molecules"]), F.lit("\nFood: "), d["actual_food"])), "\n\n")


def molecule_demos(demos: Column) -> Column:
    """A numbered block of demonstrations array<struct<target_food, partial_molecules, missing_molecules>>."""
    return F.array_join(
        F.transform(
            demos,
            lambda d, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit("\nFood: "), d["target_food"], F.lit("\nKnown molecules: "), joined(d["partial_molecules"]), F.lit("\nMissing molecules: "), joined(d["missing_molecules"])),
        ),
        "\n\n",
    )


def food_icl_prompt(demos: Column, molecules: Column) -> Column:
    return messages("You name the one food that a set of flavour molecules belongs to. Learn from the examples.", _lines(food_demos(demos), F.lit(""), _labelled("Molecules", joined(molecules)), FOOD_RULE))


def molecules_icl_prompt(demos: Column, food: Column, partial: Column, n: Column) -> Column:
    return messages(
        "You complete the flavour molecules of a food. Learn from the examples.",
        _lines(molecule_demos(demos), F.lit(""), _labelled("Food", first_truthy(food)), _labelled("Known molecules", joined(partial)), _labelled("Number of missing molecules", n.cast("string")), MOLECULE_RULE),
    )


def food_scientist_prompt(molecules: Column, selected: Column, evidence: Column, demos: Column) -> Column:
    """Generation of three hypotheses from the input, its most telling molecules, their evidence and the examples."""
    return messages(
        "You form three different hypotheses about the food behind a set of molecules.",
        _lines(_labelled("Molecules", joined(molecules)), _labelled("Most telling", joined(selected)), F.lit("Evidence"), evidence, food_demos(demos), THREE_FOODS),
    )


def molecules_scientist_prompt(food: Column, partial: Column, n: Column, evidence: Column, demos: Column, angle: int | None = None) -> Column:
    """Generation of three hypotheses, or of one under an angle."""
    rule = THREE_SETS if angle is None else MOLECULE_RULE
    return messages(
        "You form hypotheses about the missing molecules of a food.",
        _lines(_labelled("Food", first_truthy(food)), _labelled("Known molecules", joined(partial)), _labelled("n", n.cast("string")), F.lit("Evidence"), evidence, molecule_demos(demos), *([ANGLES[angle]] if angle is not None else []), rule),
    )


def reviewer_prompt(task: Column, demos: Column, hypotheses: Column, evidence: Column | None = None) -> Column:
    """Choice of one of three hypotheses; evidence is shown only in full mode (when given)."""
    shown = [F.lit("Evidence"), evidence] if evidence is not None else []
    return messages("You choose the best of three hypotheses; you do not write a new one.", _lines(task, *shown, demos, F.lit("Hypotheses"), hypotheses, CHOICE))


def category_prompt(food: Column, vocabulary: list[str]) -> Column:
    return messages("You assign a food to one category.", _lines(_labelled("Food", food), F.lit("Categories: " + ", ".join(vocabulary)), 'Answer with one JSON object: {"category": "<category>"}.'))


def groups_prompt(molecule: Column, vocabulary: list[str]) -> Column:
    return messages("You list the functional groups of a molecule.", _lines(_labelled("Molecule", molecule), F.lit("Groups: " + ", ".join(vocabulary)), 'Answer with one JSON object: {"functional_groups": ["<group>", ...]}.'))


# The judge's vocabularies.
FOOD_CATEGORIES = [
    "cereal", "plant", "seed", "flower", "animalproduct", "additive", "fishseafood", "dairy", "fruit", "bakery", "dish",
    "nutseed", "vegetable", "meat", "cerealcrop", "herb", "essentialoil", "fungus", "spice", "Vegetable", "beverage", "plantderivative",
]
FUNCTIONAL_GROUPS = [
    "thiocarboxylic", "cation", "sulfone", "hydroxy", "sulfonic", "alcohol", "ketone", "hydroxyhetarene", "amine", "aryl",
    "trialkylamine", "carboxylic", "alkyne", "ketene", "anhydride", "acetal", "amide", "derivative", "carbonitrile", "heterocyclic",
    "(alkylamine)", "aliphatic/aromatic", "imide,", "enol", "halide", "phenol", "sulfoxide", "aldehyde", "thioether", "hydroperoxide",
    "ester", "isothiocyanate", "alpha-aminoacid", "dialkylamine", "thiol", "ammonium", "aliphatic", "arylthiol", "aromatic", "thioacetal",
    "alpha-hydroxyacid", "acid", "sulfanyl", "alkylthiol", "salt", "alkene", "ether", "sulfenic", "carbonyl", "nitrite", "halogen", "chloride",
    "oxo(het)arene",
]
