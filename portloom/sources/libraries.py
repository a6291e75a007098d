"""Published group libraries, and molecules laid out with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portloom.plans import fragment

#: Fixed values: (type, pattern, hubs) of the published groups, in the published order.
JOBACK = [
    ("-CH3", "[CX4H3]", (0,)),
    ("-CH2-", "[CX4H2;!R]", (0, 0)),
    (">CH-", "[CX4H;!R]", (0, 0, 0)),
    (">C<", "[CX4H0;!R]", (0, 0, 0, 0)),
    ("CH2=CH-", "[CX3H2][CX3H1]", (1,)),
    ("-CH=CH-", "[CX3H1][CX3H1]", (0, 1)),
    ("=C<", "[$([#6X3H0;!R]);!$([#6X3H0;!R]=[#8])]", (0, 0, 0)),
    ("=C=", "[$([CX2H0](=*)=*)]", (0, 0)),
    ("CH", "[$([CX2H1]#[!#7])]", (0,)),
    ("C", "[$([CX2H0]#[!#7])]", (0, 0)),
    ("ring-CH2-", "[CX4H2;R]", (0, 0)),
    ("ring>CH-", "[CX4H;R]", (0, 0, 0)),
    ("ring>C<", "[CX4H0;R]", (0, 0, 0, 0)),
    ("ring=CH-", "[#6;$([CX3H1&R,cX3H1&R])]", (0, 0)),
    ("ring=C<", "[#6;$([#6X3H0;R]);!$([#6X3H0;R]=[#8])]", (0, 0, 0)),
    ("-F", "[F;X1]", (0,)),
    ("-Cl", "[Cl;X1]", (0,)),
    ("-Br", "[Br;X1]", (0,)),
    ("-I", "[I;X1]", (0,)),
    ("-OH (alcohol)", "[OX2H;!$([OX2H]-[#6]=[O]);!$([OX2H]-a)]", (0,)),
    ("-OH (phenol)", "[O;H1;$(O-!@c)]", (0,)),
    ("-O- (non-ring)", "[OX2H0;!R;!$([OX2H0]-[#6]=[#8])]", (0,)),
    ("-O- (ring)", "[#8X2H0;R;!$([#8X2H0]~[#6]=[#8])]", (0, 0)),
    (">C=O (non-ring)", "[C;$([CX3H0](=[OX1]));!$([CX3](=[OX1])-[OX2]);!R]=O", (0, 0)),
    (">C=O (ring)", "[$([#6X3H0](=[OX1]));!$([#6X3](=[#8X1])~[#8X2]);R]=O", (0, 0)),
    ("O=CH- (aldehyde)", "[CH;D2](=O)", (0,)),
    ("-COOH (acid)", "[OX2H]-[C]=O", (1,)),
    ("-COO- (ester)", "[#6X3H0;!$([#6X3H0](~O)(~O)(~O))](=[#8X1])[#8X2H0]", (0, 2)),
    ("=O (other than above)", "[OX1H0;!$([OX1H0]~[#6X3]);!$([OX1H0]~[#7X3]~[#8])]", (0,)),
    ("-NH2", "[NX3H2]", (0,)),
    (">NH (non-ring)", "[NX3H1;!R]", (0, 0)),
    (">NH (ring)", "[#7X3H1;R]", (0, 0)),
    (">N- (non-ring)", "[#7X3H0;!$([#7](~O)~O)]", (0, 0, 0)),
    ("-N= (non-ring)", "[#7X2H0;!R]", (0, 0)),
    ("-N= (ring)", "[#7X2H0;R]", (0, 0)),
    ("=NH", "[#7X2H1]", (0,)),
    ("-CN", "[#6X2]#[#7X1H0]", (0,)),
    ("-NO2", "[#7X3+](=[O])[O-]", (0,)),
    ("-SH", "[SX2H]", (0,)),
    ("-S- (non-ring)", "[#16X2H0;!R]", (0, 0)),
    ("-S- (ring)", "[#16X2H0;R]", (0, 0)),
]

#: Fixed values: (type, pattern, hubs) of the published groups, in the published order.
UNIFAC = [
    ("CH3", "[CX4;H3;!R]", (0,)),
    ("CH2", "[CX4;H2;!R]", (0, 0)),
    ("CH", "[CX4;H1;!R]", (0, 0, 0)),
    ("C", "[CX4;H0;!R]", (0, 0, 0, 0)),
    ("CH=CH2", "[CX3;H2]=[CX3;H1]", (1,)),
    ("CH=CH", "[CX3;H1]=[CX3;H1]", (0, 1)),
    ("C=CH2", "[CX3;H2]=[CX3;H0]", (1, 1)),
    ("C=CH", "[CX3;H1]=[CX3;H0]", (0, 1, 1)),
    ("OH (P)", "[OH1;$([OH1][CX4H2])]", (0,)),
    ("CH3OH", "[CX4;H3][OX2;H1]", ()),
    ("H2O", "[OH2]", ()),
    ("ACOH", "[cX3;H0;R][OX2;H1]", (0, 0)),
    ("CH3CO", "[CX4;H3][CX3;!H1](=O)", (1,)),
    ("CH2CO", "[CX4;H2][CX3;!H1](=O)", (0, 1)),
    ("CHO", "[CX3H1](=O)", (0,)),
    ("CH3COO", "[CH3][CX3;H0](=[O])[OH0]", (3,)),
    ("CH2COO", "[CX4;H2][CX3](=[OX1])[OX2]", (0, 3)),
    ("HCOO", "[CX3;H1](=[OX1])[OX2]", (2,)),
    ("CH3O", "[CH3;!R][OH0;!R]", (1,)),
    ("CH2O", "[CH2;!R][OH0;!R]", (0, 1)),
    ("CHO", "[C;H1;!R][OH0;!R]", (0, 0, 1)),
    ("ACH", "[cX3;H1]", (0, 0)),
    ("AC", "[cX3;H0]", (0, 0, 0)),
    ("ACCH3", "[cX3;H0][CX4;H3]", (0, 0)),
    ("ACCH2", "[cX3;H0][CX4;H2]", (0, 0, 1)),
    ("ACCH", "[cX3;H0][CX4;H1]", (0, 0, 1, 1)),
    ("THF", "[CX4;H2;R;$(C(C)OCC)][OX2;R][CX4;H2;R]", ()),
    ("CH3NH2", "[CX4;H3][NX3;H2]", ()),
    ("CH2NH2", "[CX4;H2][NX3;H2]", (0,)),
    ("CHNH2", "[CX4;H1][NX3;H2]", (0, 0)),
    ("CH3NH", "[CX4;H3][NX3;H1]", (1,)),
    ("CH2NH", "[CX4;H2][NX3;H1]", (0, 1)),
    ("CHNH", "[CX4;H1][NX3;H1]", (0, 0, 1)),
    ("CH3N", "[CX4;H3][NX3;H0]", (1, 1)),
    ("CH2N", "[CX4;H2][NX3;H0]", (0, 1, 1)),
    ("ACNH2", "[c][NX3;H2]", (0, 0)),
    ("AC2H2N", "[cX3H1][n][cX3H1]", (0, 1, 2)),
    ("AC2HN", "[cX3H0][n][cX3H1]", (0, 0, 1, 2)),
    ("AC2N", "[cX3H0][n][cX3H0]", (0, 0, 1, 2, 2)),
    ("CH3CN", "[CX4;H3][CX2]#[NX1]", ()),
    ("CH2CN", "[CX4;H2][CX2]#[NX1]", (0,)),
    ("C(=O)O", "[CX3,cX3](=[OX1])[OX2H0,oX2H0]", (0, 2)),
    ("COOH", "[CX3](=[OX1])[O;H1]", (0,)),
    ("HCOOH", "[CX3;H1](=[OX1])[OX2;H1]", ()),
    ("CH2CL", "[CX4;H2;!$(C(Cl)(Cl))](Cl)", (0,)),
    ("CHCL", "[CX4;H1;!$(C(Cl)(Cl))](Cl)", (0, 0)),
    ("CCL", "[CX4;H0](Cl)", (0, 0, 0)),
    ("CH2CL2", "[CX4;H2;!$(C(Cl)(Cl)(Cl))](Cl)(Cl)", ()),
    ("CHCL2", "[CX4;H1;!$(C(Cl)(Cl)(Cl))](Cl)(Cl)", (0,)),
    ("CCL2", "[CX4;H0;!$(C(Cl)(Cl)(Cl))](Cl)(Cl)", (0, 0)),
    ("CHCL3", "[CX4;H1;!$([CX4;H0](Cl)(Cl)(Cl)(Cl))](Cl)(Cl)(Cl)", ()),
    ("CCL3", "[CX4;H0;!$([CX4;H0](Cl)(Cl)(Cl)(Cl))](Cl)(Cl)(Cl)", (0,)),
    ("CCL4", "[CX4;H0]([Cl])([Cl])([Cl])([Cl])", ()),
    ("ACCL", "[c][Cl]", (0, 0)),
    ("CH3NO2", "[CX4;H3][N+X3](=[OX1])([O-X1])", ()),
    ("CH2NO2", "[CX4;H2][N+X3](=[OX1])([O-X1])", (0,)),
    ("CHNO2", "[CX4;H1][N+X3](=[OX1])([O-X1])", (0, 0)),
    ("ACNO2", "[cX3][N+X3](=[OX1])([O-X1])", (0, 0)),
    ("CS2", "C(=S)=S", ()),
    ("CH3SH", "[SX2H][CX4;H3]", ()),
    ("CH2SH", "[SX2H][CX4;H2]", (0,)),
    ("FURFURAL", "c1cc(oc1)C=O", ()),
    ("DOH", "[OX2;H1][CX4;H2][CX4;H2][OX2;H1]", ()),
    ("I", "[I]", (0,)),
    ("BR", "[Br]", (0,)),
    ("CH=-C", "[CX2;H1]#[CX2;H0]", (1,)),
    ("C=-C", "[CX2;H0]#[CX2;H0]", (0, 1)),
    ("DMSO", "[SX3H0](=[OX1])([CX4;H3])[CX4;H3]", ()),
    ("ACRY", "[CX3;H2]=[CX3;H1][CX2;H0]#[NX1;H0]", ()),
    ("CL-(C=C)", "[$([Cl;H0]([C]=[C]))]", (0,)),
    ("C=C", "[CX3;H0]=[CX3;H0]", (0, 0, 1, 1)),
    ("ACF", "[cX3][F]", (0, 0)),
    ("DMF", "[CX4;H3][N]([CX4;H3])[CX3;H1]=[O]", ()),
    ("HCON(CH2)2", "[NX3]([CX4;H2])([CX4;H2])[CX3;H1](=[OX1])", (1, 2)),
    ("CF3", "C(F)(F)F", (0,)),
    ("CF2", "C(F)F", (0, 0)),
    ("CF", "C(F)", (0, 0, 0)),
    ("CY-CH2", "[CH2;R]", (0, 0)),
    ("CY-CH", "[CH1;R]", (0, 0, 0)),
    ("CY-C", "[CH0;R]", (0, 0, 0, 0)),
    ("OH (S)", "[OH1;$([OH1][CX4H1])]", (0,)),
    ("OH (T)", "[OH1;$([OH1][CX4H0])]", (0,)),
    ("CY-CH2O", "[CX4H2;R][OX2;R;$(O(CC)C)][CX4H2;R][OX2;R][CX4H2;R]", (0, 4)),
    ("TRIOXAN", "[CX4H2;R][OX2;R;$(O(C)C)]", (0, 1)),
    ("CNH2", "[CX4H0][NH2]", (0, 0, 0)),
    ("NMP", "[OX1H0]=[C;R][NX3H0;R][CH3]", (1, 2)),
    ("NEP", "[OX1H0]=[CH0X3;R][NX3H0;R][CH2]", (1, 2, 3)),
    ("NIPP", "[OX1H0;!R]=[CX3H0;R][NX3H0;R][C;!R]", (1, 2, 3, 3, 3)),
    ("NTBP", "[OX1H0;!R]=[CH0X3;R][NX3H0;R][CH0;!R]", (0, 1, 2, 2, 2)),
    ("CONH2", "[CX3H0](=[OX1H0])[NX3H2]", (0,)),
    ("CONHCH3", "[OX1H0;!R]=[CX3H0;!R][NH1X3;!R][CH3;!R]", (1,)),
    ("CONHCH2", "[CH2X4;!R][NH1X3;!R][CX3H0;!R]=[OX1H0;!R]", (0, 2)),
]

#: Fixed values: (type, pattern, hubs) of the published groups, in the published order.
SAFT = [
    ("CH3", "[CX4H3]", (0,)),
    ("CH2", "[CX4H2;!R]", (0, 0)),
    ("CH", "[CX4H;!R]", (0, 0, 0)),
    ("C", "[CX4H0;!R]", (0, 0, 0, 0)),
    ("aCH", "[cX3;H1]", (0, 0)),
    ("aCCH2", "[cX3;H0][CX4;H2]", (0, 0, 1)),
    ("aCCH", "[cX3;H0][CX4;H1]", (0, 0, 1, 1)),
    ("CH2=", "[CX3H2]", (0,)),
    ("CH=", "[CX3H1;!R;!$([CX3H1](=O))]", (0, 0)),
    ("cCH2", "[CH2;R]", (0, 0)),
    ("COOH", "[OX2H]-[C]=O", (1,)),
    ("COO", "[#6X3H0;!$([#6X3H0](~O)(~O)(~O))](=[#8X1])[#8X2H0]", (0, 2)),
    ("OH", "[OX2H;!$([OX2H]-[#6]=[O]);!$([OX2H]-a)]", (0,)),
    ("CH2OH", "[CX4;H2;!R][OH1]", (0,)),
    ("CHOH", "[CX4;H1;!R][OH1]", (0, 0)),
    ("NH2", "[NX3H2]", (0,)),
    ("NH", "[NX3H1;!R]", (0, 0)),
    ("N", "[#7X3H0;!$([#7](~O)~O);!R]", (0, 0, 0)),
    ("cNH", "[#7X3H1;R]", (0, 0)),
    ("cN", "[#7X3H0;R]", (0, 0, 0)),
    ("C=", "[CX3H0;!R;!$([CX3H0](=O))]", (0, 0, 0)),
    ("aCCH3", "[cX3;H0][CX4;H3]", (0, 0)),
    ("aCOH", "[cX3;H0;R][OX2;H1]", (0, 0)),
    ("cCH", "[CH1;R]", (0, 0, 0)),
    ("cCHNH", "[CH1;R][NH1;!R]", (0, 0, 1)),
    ("cCHN", "[CH1;R][NH0;!R]", (0, 0, 1, 1)),
    ("aCCOaC", "[cH0][C;!R](=O)[cH0]", (0, 0, 0, 3, 3, 3)),
    ("aCCOOH", "[OX2H]-[C](=O)[cH0]", (3, 3, 3)),
    ("aCNHaC", "[cH0][NH1;!R][cH0]", (0, 0, 0, 2, 2, 2)),
    ("CH3CO", "[CH3][CX3](=O)", (1,)),
    ("eO", "[OH0;!R;$([OH0;!R][CH3;!R]);$([OH0;!R][CH2;!R])]", (0, 0)),
    ("cO", "[OH0;!R;$([OH0;!R][CH2;!R])]", (0, 0)),
    ("CH3OH", "[CX4;H3][OX2;H1]", ()),
    ("H2O", "[OH2]", ()),
    ("CH4", "[CH4]", ()),
    ("CO2", "[C;X2](=O)(=O)", ()),
]

LIBRARIES = {"joback": JOBACK, "unifac": UNIFAC, "saft": SAFT}
#: What stands in for single atoms that no group covers.
SINGLE = [("DEFAULT#6", "[#6]"), ("DEFAULT#7", "[#7]"), ("DEFAULT#8", "[#8]"), ("DEFAULT#9", "[#9]"), ("DEFAULT#16", "[#16]"), ("DEFAULT#17", "[#17]"), ("DEFAULT#35", "[#35]"), ("DEFAULT", "[*]")]


#: Where the published groups are from.
DOI = {"joback": "https://doi.org/10.1021/i200013a024", "unifac": "https://doi.org/10.1021/i200013a024", "saft": "https://doi.org/10.1080/00268978800101601"}
TRACE = "library string, ordinal int, type string, pattern string, pattern_type string, hubs array<int>, doi string, extended string, priority int"


def groups(spark: SparkSession, library: str) -> DataFrame:
    """A library's groups with their traces; types may repeat, the ordinal tells groups apart. Published groups have no extended pattern and no priority here."""
    rows = [(library, i, t, p, "SMARTS", list(h), DOI[library], None, None) for i, (t, p, h) in enumerate(LIBRARIES[library])]
    return spark.createDataFrame(rows, TRACE)


def added(library: DataFrame, name: str, group: tuple[str, str, Sequence[int]], pattern_type: str = "SMARTS", doi: str | None = None, extended: str | None = None, priority: int | None = None) -> DataFrame:
    """The library with one group more, after its last."""
    kind, pattern, hubs = group
    if not kind and not pattern:
        raise ValueError("a group needs a type or a pattern")
    new = library.sparkSession.createDataFrame([(name, kind, pattern, pattern_type, list(hubs), doi, extended, priority)], TRACE.replace("ordinal int, ", ""))
    last = library.filter(F.col("library") == name).agg(F.coalesce(F.max("ordinal") + 1, F.lit(0)).alias("ordinal"))
    return library.unionByName(new.join(F.broadcast(last)))


def sizes(library: DataFrame) -> DataFrame:
    """(library, n_groups)."""
    return library.groupBy("library").agg(F.count(F.lit(1)).cast("int").alias("n_groups"))


def histograms(molecules: DataFrame, library: str, on_fail: str = "remove") -> DataFrame:
    """(smiles, type, n): the groups of each molecule's first complete result, greatest groups laid first.

    A molecule that the library doesn't cover gives no rows (``remove``), single
    atoms for what is left (``itemize``), one group that is the molecule
    (``condense``), or stops the query (``error``).
    """
    if on_fail not in ("remove", "itemize", "condense", "error"):
        raise ValueError(f"unknown on_fail {on_fail!r}")

    def counted(rows: list[tuple[str, str]]) -> DataFrame:
        types = F.create_map(*[F.lit(x) for i, (t, _) in enumerate(rows) for x in (i, t)])
        laid = fragment.laid_out(molecules.select("smiles").distinct(), [p for _, p in rows], sorter="size").filter("result = 0")
        return laid.select("smiles", F.explode("chosen").alias("i")).groupBy("smiles", F.element_at(types, F.col("i")).alias("type")).agg(F.count(F.lit(1)).alias("n"))

    own = [(t, p) for t, p, _ in LIBRARIES[library]]
    found = counted(own)
    if on_fail == "remove":
        return found
    left = molecules.select("smiles").distinct().join(found.select("smiles").distinct(), "smiles", "left_anti")
    if on_fail == "error":
        stop = F.raise_error(F.concat(F.lit("no groups of the library cover "), "smiles"))
        return found.unionByName(left.select("smiles", stop.cast("string").alias("type"), F.lit(0).cast("bigint").alias("n")))
    if on_fail == "condense":
        return found.unionByName(left.select("smiles", F.col("smiles").alias("type"), F.lit(1).cast("bigint").alias("n")))
    return found.unionByName(counted(own + SINGLE).join(left, "smiles", "left_semi"))
