"""Templates against the language's own formatting."""

import random

from pyspark.sql import functions as F

from pagebundle.functions import formats
from pagebundle.operators import verdicts as vd

NAMES = ("a", "b")
TEXTS = ["", "x", "it's", 'a "quoted" one', "both ' and \"", "tab\tline\nend\r", "back\\slash", "zażółć",
         " ­ \x00\x7f\x9f", "\U0001f600 smile ", "long " * 30, "{a}"]


def random_template(rng):
    parts = []
    for _ in range(rng.randint(1, 3)):
        fill = rng.choice(["", "", "*", "0", "<", "ż"])
        align = rng.choice(["<", ">", "^"]) if fill else rng.choice(["", "<", ">", "^"])
        spec = (fill + align + rng.choice(["", "0"]) + rng.choice(["", "3", "12", "40"])
                + rng.choice(["", ".0", ".2", ".7"]) + rng.choice(["", "s"]))
        parts.append(
            rng.choice(["", "{{", "}} ", "text "]) + "{" + rng.choice(NAMES)
            + rng.choice(["", "", "[0]", "[4]"]) + rng.choice(["", "", "!r", "!s", "!a"])
            + (":" + spec if spec else rng.choice(["", ":"])) + "}"
        )
    return "".join(parts)


def test_random_templates_match_the_language(spark):
    rng = random.Random(11)
    templates = [random_template(rng) for _ in range(40)] + ["{a!r}", "{b!a}", "{a:x<05}", "{b:<05}"]
    rows = [(i, a, rng.choice(TEXTS)) for i, a in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    shown = [
        F.when(fits, text).alias(f"t{n}")
        for n, (text, fits) in enumerate(formats.compile_template(t, NAMES) for t in templates)
    ]
    got = df.select("i", *shown).orderBy("i").collect()
    for (_, a, b), row in zip(rows, got):
        for template, value in zip(templates, row[1:]):
            try:
                want = template.format(a=a, b=b)
            except IndexError:
                want = None
            assert value == want, (template, a, b)


def test_faults_are_those_of_the_language(spark):
    faulty = ["{", "}", "{c}", "{}", "{0}", "{a:d}", "{a:+5}", "{a:=5}", "{a:#s}", "{a:,}", "{a:.}", "{a:5.}",
              "{a!x}", "{a:z}", "{a: 5}"]
    for template in faulty:
        try:
            template.format(a="x", b="y")
        except (KeyError, IndexError, ValueError):
            pass
        else:
            raise AssertionError(template)
        assert formats.template_fault(template, NAMES), template
    assert formats.template_fault("{a:{b}}", NAMES) and formats.template_fault("{a:99999999999}", NAMES)
    assert formats.template_fault("{{{a!r:>20}}}", NAMES) is None and formats.template_fault("", NAMES) is None
    named = {"user": "{nope}", "system": "{znane_typy:>9}", "none": None}
    assert [r.template for r in vd.template_warnings(spark, named).collect()] == ["user"]
    assert vd.template_warnings(spark, {}).count() == 0
