"""A hand-made department: twelve triples in six graphs, and the classes they use."""

from pyspark.sql import types as T

from tripletide.schema import AXIOMS
from tripletide.scratch import literal_rows

QUADS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("seq", "graph_no")]
    + [T.StructField(c, T.StringType()) for c in ("s", "p", "o", "o_kind")]
)

TYPE = "rdf:type"

# (kind, a, b, c, d)
AXIOM_ROWS = [
    ("subclass", "FullProfessor", "Professor", None, None),
    ("subclass", "Professor", "Faculty", None, None),
    ("subclass", "Faculty", "Employee", None, None),
    ("subclass", "Chair", "Professor", None, None),
    ("subclass", "Dean", "Professor", None, None),
    ("subclass", "Department", "Organization", None, None),
    ("subclass", "College", "Organization", None, None),
    ("subclass", "Program", "Organization", None, None),
    ("subclass", "ResearchGroup", "Organization", None, None),
    ("subclass", "GraduateCourse", "Course", None, None),
    ("subclass", "GraduateStudent", "Person", None, None),
    ("subclass", "ResearchAssistant", "Person", None, None),
    ("sub_some", "GraduateStudent", None, "takesCourse", "GraduateCourse"),
    ("sub_some", "ResearchAssistant", None, "worksFor", "ResearchGroup"),
    ("equiv_some", "Chair", "Person", "headOf", "Department"),
    ("equiv_some", "Dean", None, "headOf", "College"),
    ("equiv_some", "Director", "Person", "headOf", "Program"),
    ("equiv_some", "Employee", "Person", "worksFor", "Organization"),
    ("equiv_some", "Student", "Person", "takesCourse", "Course"),
    ("equiv_some", "TeachingAssistant", "Person", "teachingAssistantOf", "Course"),
    ("subprop", "headOf", "worksFor", None, None),
    ("subprop", "worksFor", "memberOf", None, None),
    ("inverse", "memberOf", "member", None, None),
    ("domain", "member", "Organization", None, None),
    ("range", "member", "Person", None, None),
    ("domain", "advisor", "Person", None, None),
    ("range", "advisor", "Professor", None, None),
    ("domain", "teacherOf", "Faculty", None, None),
    ("range", "teacherOf", "Course", None, None),
    ("domain", "emailAddress", "Person", None, None),
    ("transitive", "subOrganizationOf", None, None, None),
    ("domain", "subOrganizationOf", "Organization", None, None),
    ("range", "subOrganizationOf", "Organization", None, None),
]

TRIPLES = [
    ("d1", TYPE, "Department", "iri"),
    ("a", "headOf", "d1", "iri"),
    ("b", TYPE, "FullProfessor", "iri"),
    ("c", "advisor", "b", "iri"),
    ("c", "takesCourse", "k1", "iri"),
    ("k1", TYPE, "GraduateCourse", "iri"),
    ("e", "worksFor", "d1", "iri"),
    ("d1", "subOrganizationOf", "u1", "iri"),
    ("u1", "subOrganizationOf", "w", "iri"),
    ("f", TYPE, "GraduateStudent", "iri"),
    ("h", "teacherOf", "k1", "iri"),
    ("h", "emailAddress", "h@x", "lit"),
]


def axioms(spark, rows=AXIOM_ROWS):
    return literal_rows(spark, rows, AXIOMS)


def quads(spark, triples=TRIPLES, n=2):
    return literal_rows(spark, [(i, i // n, *t) for i, t in enumerate(triples)], QUADS)


def subjects(spark, *values):
    return literal_rows(spark, [(v,) for v in values], T.StructType([T.StructField("s", T.StringType())]))


def names(df, col="s"):
    return {r[col] for r in df.collect()}
