import pytest

from metricspark import catalogue
from metricspark.lang import nodes as N
from metricspark.lang.checker import compile_source, read_definitions
from metricspark.lang.grammar import parse
from metricspark.lang.versions import Versions, render

WORLD = """
# Somebody who carries orders.
fact courier:
    name name
    name as text
    timezone as text
    cleared as number
    many badges:
        code as text

# One order.
fact job:
    ref as text
    courier_id as text
    depot_id as text
    status as text
    rush as flag
    weight as number
    placed as moment
    done as moment
    one dropoff:
        street as text

# A place.
fact depot:
    name name
    name as text

group job.by_courier from courier_id
group job.by_courier_day from (courier_id, placed by day in courier.timezone)
group job.by_courier_depot from (courier_id, depot_id)
group job.by_badge from courier_id through courier.badges.code
group job.spans from (courier_id, placed until done by week in "UTC" excluding weeks gone carrying overdue weeks)
filter job.open where status != "done"
filter job.rushed where rush == true
filter job.old where placed older than 14 days
measure job.length = done - placed
measure job.mass = weight in amount
measure job.waiting = now - placed

# Orders in hand.
figure courier.hand:
    display "{courier} has {value}"
    depends:
        mine = job.by_courier:{courier} & job.open
    calculate:
        count(mine)
    band:
        when value > courier.cleared then "over"
        otherwise "ok"

# Orders of a day.
figure courier.days bucketed:
    display "days"
    depends:
        mine = job.by_courier_day:{courier}
    calculate:
        count(mine)

# Orders at depots.
figure courier.at_depots across depot:
    display "depots"
    depends:
        mine = job.by_courier_depot:{courier}
    calculate:
        count(mine)
"""


def ok(more=""):
    return compile_source(WORLD + more)


def figure(body, head="courier.f", doc="# Told.\n"):
    return f"\n\n{doc}figure {head}:\n" + "\n".join("    " + x for x in body.strip("\n").split("\n"))


def test_reads_all_kinds_of_declarations():
    lib = ok()
    assert lib.facts["courier"].many == ("badges",) and lib.facts["job"].type_of("dropoff.street") == "text"
    assert lib.groups["job.by_badge"].parts[0].through == ("courier", "badges.code")
    assert lib.groups["job.spans"].tail == N.Part("placed", grain="week", zone="UTC", until="done", gone=True, overdue=True)
    assert lib.figures["courier.hand"].doc == "Orders in hand."
    assert lib.filters["job.old"].test == N.Age("placed", True, 14.0)


def test_precedence():
    f = parse("figure a.b:\n    calculate:\n        1 + 2 * (3 - 4) / 5").figures["a.b"].calc
    assert f == N.Arith("+", N.Num(1), N.Arith("/", N.Arith("*", N.Num(2), N.Arith("-", N.Num(3), N.Num(4))), N.Num(5)))
    s = parse("figure a.b:\n    depends:\n        x = a.p - (a.q | a.r) & a.s\n    calculate:\n        count(x)").figures["a.b"].depends[0][1]
    assert s == N.SetOp("&", N.SetOp("-", N.Bucket("a.p"), N.SetOp("|", N.Bucket("a.q"), N.Bucket("a.r"))), N.Bucket("a.s"))


def test_prose_belongs_to_what_it_touches():
    lib = parse("# far\n\n\nfact a:\n    x as text\n\n# near\n\nfact b:\n    x as text  # aside\n")
    assert lib.facts["a"].doc == "" and lib.facts["b"].doc == "near"


REFUSED = {
    "unexplained": figure('display "x"\ndepends:\n    m = job.by_courier:{courier}\ncalculate:\n    count(m)', doc=""),
    "no display": figure("depends:\n    m = job.by_courier:{courier}\ncalculate:\n    count(m)"),
    "no group": figure('display "x"\ndepends:\n    m = job.open\ncalculate:\n    count(m)'),
    "group unscoped": figure('display "x"\ndepends:\n    m = job.by_courier & job.open\ncalculate:\n    count(m)'),
    "filter scoped": figure('display "x"\ndepends:\n    m = job.by_courier:{courier} & job.open:{courier}\ncalculate:\n    count(m)'),
    "bucketed lacks": figure('display "x"\ndepends:\n    m = job.by_courier_day:{courier}\ncalculate:\n    count(m)'),
    "bucketed too much": figure('display "x"\ndepends:\n    m = job.by_courier:{courier}\ncalculate:\n    count(m)', head="courier.f bucketed"),
    "across lacks": figure('display "x"\ndepends:\n    m = job.by_courier_depot:{courier}\ncalculate:\n    count(m)'),
    "across itself": figure('display "x"\ndepends:\n    m = job.by_courier_depot:{courier}\ncalculate:\n    count(m)', head="courier.f across courier"),
    "unknown field": "\nfilter job.x where nothing == 1",
    "record as value": '\nfilter job.x where dropoff == "a"',
    "flag as word": '\nfilter job.x where rush == "true"',
    "word as number": "\nfilter job.x where status == 3",
    "age of no moment": "\nfilter job.x where status older than 3 days",
    "time first": "\ngroup job.x from (placed by day, courier_id)",
    "three parts": "\ngroup job.x from (courier_id, depot_id, status)",
    "no such zone": '\ngroup job.x from (courier_id, placed by day in "Mars/Olympus")',
    "span by hour": "\ngroup job.x from (courier_id, placed until done by hour)",
    "clause without span": "\ngroup job.x from (courier_id, placed by week excluding weeks gone)",
    "clause of other grain": "\ngroup job.x from (courier_id, placed until done by week excluding days gone)",
    "measure of other kind": figure('display "x"\ndepends:\n    m = job.by_courier_day:{courier}\ncalculate:\n    sum(courier.cleared over m)', head="courier.f bucketed"),
    "clock stored": figure('display "x"\ndepends:\n    m = job.by_courier:{courier}\ncalculate:\n    list(job.waiting over m)'),
    "sum of durations": figure('display "x"\ndepends:\n    m = job.by_courier:{courier}\ncalculate:\n    sum(job.length over m)'),
    "median undivided": figure('display "x"\ndepends:\n    m = job.by_courier:{courier}\ncalculate:\n    median(job.length over m)'),
    "field without unit": figure('display "x"\ndepends:\n    m = job.by_courier:{courier}\ncalculate:\n    sum(job.weight over m)'),
    "bare sequence": figure('display "x"\nunit count\ncalculate:\n    courier.days + 1'),
    "coordinate of none": figure('display "x"\nunit count\ncalculate:\n    courier.hand:{bucket} + 1', head="courier.f bucketed"),
    "rollup of undivided": figure('display "x"\ncalculate:\n    sum(courier.hand)'),
    "later figure": figure('display "x"\nunit count\ncalculate:\n    courier.later + 1'),
    "mixed ladder": figure('display "x"\ncalculate:\n    when courier.hand > 1 then "a"\n    otherwise 2'),
    "no otherwise": figure('display "x"\ncalculate:\n    when courier.hand > 1 then "a"'),
    "band of numbers": figure('display "x"\ndepends:\n    m = job.by_courier:{courier}\ncalculate:\n    count(m)\nband:\n    when value > 1 then 2\n    otherwise 3'),
    "carry by nothing": figure('display "x"\ndepends:\n    m = job.by_courier:{courier}\ncalculate:\n    count(m) carried forward'),
    "name of a field": figure('display "x"\ndepends:\n    m = job.by_courier:{courier}\ncalculate:\n    count(m)', head="courier.cleared"),
    "two spaces of ids": "\nfilter courier.known where name is set" + figure('display "x"\ndepends:\n    m = job.by_courier:{courier} & courier.known\ncalculate:\n    count(m)'),
    "declared twice": "\nfilter job.open where rush == true",
    "limit without order": '\n\n# P.\nprojection job.p:\n    limit 3\n    field:\n        r = ref as text',
    "unbound sort": '\n\n# P.\nprojection job.p:\n    sort by z\n    field:\n        r = ref as text',
    "column of other type": '\n\n# P.\nprojection job.p:\n    field:\n        r = ref as number',
    "population that ages": '\n\n# P.\nprojection job.p:\n    from job.old\n    field:\n        r = ref as text',
    "reading of no sequence": '\n\n# R.\nreading courier.r(range):\n    display "x"\n    depends:\n        v = courier.hand in range\n    calculate:\n        sum(v)',
    "sum beside median": '\n\n# R.\nreading courier.r(range):\n    display "x"\n    depends:\n        v = courier.days in range\n    calculate:\n        sum(v)\n        median(v)',
    "band on what isn't": '\n\n# R.\nreading courier.r(range):\n    display "x"\n    depends:\n        v = courier.days in range\n    calculate:\n        sum(v)\n    band:\n        when value > 1 then "a"\n        otherwise "b"',
    "bundle of sequence": "\n\n# B.\nbundle courier.b:\n    d = figure courier.days",
    "tabs": "\n\n# T.\nfact t:\n\tx as text",
}


@pytest.mark.parametrize("name", REFUSED)
def test_refusals(name):
    with pytest.raises(N.DefinitionError):
        ok(REFUSED[name])


def test_a_refusal_names_its_line():
    with pytest.raises(N.DefinitionError, match=r"line 2"):
        compile_source("# A.\nfact a:\n    name missing\n    x as text")


def test_versions_cover_what_decides_values():
    base = Versions(ok()).of("courier.hand")
    assert Versions(compile_source(WORLD.replace("Orders in hand.", "Told otherwise."))).of("courier.hand") == base
    assert Versions(compile_source(WORLD.replace('"{courier} has {value}"', '"else"'))).of("courier.hand") == base
    assert Versions(compile_source(WORLD.replace('status != "done"', 'status != "gone"'))).of("courier.hand") != base
    assert Versions(compile_source(WORLD.replace('then "over"', 'then "above"'))).of("courier.hand") != base
    assert Versions(compile_source("\n\n\n" + WORLD)).of("courier.hand") == base
    derived = figure('display "x"\nunit count\ncalculate:\n    courier.hand * 2')
    one, two = Versions(ok(derived)).of("courier.f"), Versions(compile_source(WORLD.replace('status != "done"', 'status != "gone"') + derived)).of("courier.f")
    assert one != two


def test_definitions_of_a_folder(tmp_path):
    (tmp_path / "b.fig").write_text("# B.\nfact b:\n    x as text\n")
    (tmp_path / "a.fig").write_text("# A.\nfact a:\n    x as text\n")
    assert list(compile_source(read_definitions(str(tmp_path))).facts) == ["a", "b"]
    assert render(catalogue.library()) == render(catalogue.library())
