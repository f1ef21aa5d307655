"""Writers: GeoJSON, the error document, CSV, the issue map."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.location import location_db, location_feature
from ..operators.errors import COLUMNS, TECHNICAL, error_message
from ..operators.materialise import discard, keep_lean, shared_dir, sliced
from ..operators.numbering import numbered
from ..operators.rotation import ccw_next, half_edges

#: Element names of an error's parameters in the document (fixed values).
TAGS = {"x": "X", "y": "Y", "is_loc": "IS", "o_loc": "O", "cw_loc": "CW", "ccw_loc": "CCW", "x2": "X2", "y2": "Y2", "obj": "OBJ", "tx": "TX", "ty": "TY"}


def error_elements(errors: DataFrame) -> DataFrame:
    """(i, xml): one `e` element per error. Element text is numbers only, so nothing needs escaping."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{TAGS[c]}>"), F.col(c).cast("string"), F.lit(f"</{TAGS[c]}>"))) for c in COLUMNS if c != "t"]
    p = F.when(F.col("p").isNotNull(), F.concat(F.lit(' p="'), F.col("p").cast("string"), F.lit('"'))).otherwise("")
    return errors.select("i", F.concat(F.lit('<e i="'), F.col("i").cast("string"), F.lit('" t="'), "t", F.lit('"'), p, F.lit(">"), F.concat_ws("", *parts), F.lit("</e>")).alias("xml"))


def _write_joined(lines: DataFrame, path: str, head: str, tail: str, skip: int = 0) -> None:
    """One file of all lines: executors write the parts, which are then joined as bytes in the order of partitions. The first `skip` bytes of
    the first line are left out."""
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    lines.write.text(parts.toString())
    fs = parts.getFileSystem(conf)
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(head.encode()))
        for name in sorted(f.getPath().getName() for f in fs.listStatus(parts)):
            if name.startswith("part-"):
                data = fs.open(jvm.org.apache.hadoop.fs.Path(parts, name))
                if data.available():
                    data.skip(skip)
                    skip = 0
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, 1 << 16, False)
                data.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
        fs.delete(parts, True)


def write_error_document(errors: DataFrame, path: str, name: str) -> None:
    """The whole document as one file, in the order of i."""
    from xml.sax.saxutils import quoteattr

    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<ete:TopologicalErrors xmlns:ete="urn:meshwork:errors" name={quoteattr(name)}>\n'
    _write_joined(error_elements(errors).orderBy("i").select("xml"), path, head, "</ete:TopologicalErrors>\n")


def read_error_document(spark: SparkSession, path: str) -> DataFrame:
    """An error document as the error relation again."""
    schema = "_i bigint, _t string, _p bigint, " + ", ".join(f"{TAGS[c]} {k}" for c, k in COLUMNS.items() if c != "t")
    rows = spark.read.format("xml").option("rowTag", "e").schema(schema).load(path)
    return rows.select(F.col("_i").alias("i"), F.col("_t").alias("t"), F.col("_p").alias("p"), *[F.col(TAGS[c]).alias(c) for c in COLUMNS if c != "t"])


def error_points(errors: DataFrame) -> DataFrame:
    """(id, feature): a GeoJSON point feature per error."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    properties = F.struct(F.col("i").cast("string").alias("id"), error_message(errors.columns).alias("e"))
    return errors.select(F.col("i").alias("id"), F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("feature"))


def named_locations(errors: DataFrame) -> DataFrame:
    """The distinct locations that errors name in any role."""
    each = errors.select(F.explode(F.array("is_loc", "o_loc", "cw_loc", "ccw_loc")).alias("location"))
    return each.where("location IS NOT NULL AND location <> 0").distinct()


def rings(vertices: DataFrame, *by: str) -> DataFrame:
    """(object_id, *by, coordinates): an object's rings, its exterior first; consecutive equal vertices are one, rings are closed."""
    v = F.struct("seg_ord", "v_ord", F.array("x", "y").alias("p"))
    ring = vertices.groupBy("object_id", *by, "ring_no").agg(F.transform(F.array_sort(F.collect_list(v)), lambda s: s["p"]).alias("ps"))
    once = F.filter("ps", lambda p, i: (i == 0) | (p != F.get("ps", i - 1)))
    closed = ring.withColumn("ps", once).withColumn("ps", F.when(F.get("ps", F.lit(0)) == F.get("ps", F.size("ps") - 1), F.col("ps")).otherwise(F.concat("ps", F.array(F.get("ps", F.lit(0))))))
    return closed.groupBy("object_id", *by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ring_no", "ps"))), lambda s: s["ps"]).alias("coordinates"))


def _feature(name, geometry):
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(name.alias("id"))), F.lit(',"geometry":'), geometry, F.lit("}")).alias("feature")


def polygons(vertices: DataFrame) -> DataFrame:
    """(id, feature): a GeoJSON Polygon per object."""
    geometry = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.col("coordinates")))
    return rings(vertices).select(F.col("object_id").alias("id"), _feature(F.col("object_id").cast("string"), geometry))


def erroneous_features(errors: DataFrame, vertices: DataFrame, features: DataFrame, slices: int = 1) -> DataFrame:
    """(feature_id, feature): the whole features that errors name, each once: a Polygon, or a MultiPolygon of all its patches. vertices with packed
    locations; features as `lookup.features_at` takes them. In several slices of features the result is a table of `keep_lean`, as a shuffle of all vertices is larger."""
    key = lambda c: (location_db(c).alias("db"), location_feature(c).alias("pos"))
    wanted = named_locations(errors).select(*key("location")).distinct()
    f = features.where("patches > 0").select(F.col("db_idx").alias("db"), (F.col("first_geometry") + 1).alias("pos"), "feature_id")
    wanted, v, at = wanted.join(f, ["db", "pos"]), vertices.select("*", *key("location")), ("db", "pos")
    if slices == 1:
        return _whole_features(v, wanted)
    wanted = keep_lean(wanted)
    out = keep_lean(*sliced(slices, _whole_features, (v, at), (wanted, at)))
    discard(wanted)
    return out


def _whole_features(vertices: DataFrame, wanted: DataFrame) -> DataFrame:
    own = vertices.join(wanted, ["db", "pos"])
    each = rings(own, "db", "pos", "feature_id").groupBy("db", "pos", "feature_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("object_id", "coordinates"))), lambda s: s["coordinates"]).alias("all"))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get("all", F.lit(0)).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("all").alias("coordinates")))
    return each.select("feature_id", _feature(F.col("feature_id"), F.when(F.size("all") == 1, one).otherwise(many)))


def exported(errors: DataFrame, codes: list[str] | None = None) -> DataFrame:
    return errors if codes else errors.where(~F.col("t").isin(*TECHNICAL))


def write_feature_collection(features: DataFrame, path: str) -> None:
    """One GeoJSON file."""
    _write_joined(features.select(F.concat(F.lit(","), "feature")), path, '{"type":"FeatureCollection","features":[\n', "]}\n", skip=1)


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON, written by the executors."""
    features.select("feature").write.text(path)


def edge_dump(edges: DataFrame) -> DataFrame:
    """Edges in eleven columns: a number in order of creation, both ends, angles in degrees, the counter-clockwise next edge at either end (negative
    where that edge ends there), owners and their locations (0 for none)."""
    e = numbered(edges, ["created_key"], "edge")
    turned = ccw_next(half_edges(e)).select("edge_key", "sign", "next_edge", "next_sign")
    own = turned.join(e.select(F.col("edge_key").alias("next_edge"), F.col("edge").alias("next_no")), "next_edge")
    ends = own.groupBy("edge_key").agg(*[F.max(F.when(F.col("sign") == s, F.col("next_no") * F.col("next_sign"))).alias(n) for s, n in ((1, "source_next"), (-1, "target_next"))])
    point = lambda end: F.concat_ws(" ", F.col(f"{end}_x").cast("string"), F.col(f"{end}_y").cast("string"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return e.join(ends, "edge_key").select(
        "edge", point("src").alias("source"), point("tgt").alias("target"), F.degrees("src_angle").alias("source_degrees"), F.degrees("tgt_angle").alias("target_degrees"),
        "source_next", "target_next", none("left_obj"), none("right_obj"), none("left_loc"), none("right_loc"),
    )


def write_edge_csv(edges: DataFrame, path: str) -> None:
    edge_dump(edges).write.option("sep", ";").option("header", True).csv(path)


_MAP = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>__TITLE__</title>
<style>body{margin:0;font:14px sans-serif}svg{width:100vw;height:88vh}path{fill:#dbe7f3;stroke:#567}path:hover{fill:#b9d3ee}circle{fill:#c22}circle.on{fill:#06c}p{margin:6px}</style></head>
<body><p id="m">Arrow keys go through the issues. A click shows a feature and its nearest vertex; arrows show how rings run.</p><svg id="s"></svg><script>
const say=t=>document.getElementById('m').textContent=t,esc=t=>String(t).replace(/[<>&"]/g,c=>`&#${c.charCodeAt(0)};`);
fetch(__DATA__).then(r=>r.json()).then(g=>{
 const points=g.features.filter(f=>f.geometry.type==='Point'),areas=g.features.filter(f=>f.geometry.type!=='Point');
 const ringsOf=f=>f.geometry.type==='Polygon'?f.geometry.coordinates:f.geometry.coordinates.flat();
 const all=[...points.map(f=>f.geometry.coordinates),...areas.flatMap(f=>ringsOf(f).flat())];
 let x0=Infinity,x1=-Infinity,y0=Infinity,y1=-Infinity;for(const [x,y] of all){x0=Math.min(x0,x);x1=Math.max(x1,x);y0=Math.min(y0,y);y1=Math.max(y1,y);}
 const w=x1-x0||1,h=y1-y0||1,svg=document.getElementById('s'),at=p=>`${p[0]-x0} ${y1-p[1]}`;svg.setAttribute('viewBox',`0 0 ${w} ${h}`);
 const arrow='<defs><marker id="a" viewBox="0 0 6 6" refX="3" refY="3" markerWidth="5" markerHeight="5" orient="auto"><path d="M0 0L6 3L0 6z"/></marker></defs>';
 svg.innerHTML=arrow+areas.map((f,i)=>`<path data-i="${i}" fill-rule="evenodd" marker-mid="url(#a)" stroke-width="${w/2000}" d="${ringsOf(f).map(r=>'M'+r.map(at).join('L')+'Z').join('')}"><title>${esc(f.properties.id)}</title></path>`).join('')
  +points.map((f,i)=>`<circle data-p="${i}" r="${w/400}" cx="${f.geometry.coordinates[0]-x0}" cy="${y1-f.geometry.coordinates[1]}"><title>${esc(f.properties.e)}</title></circle>`).join('');
 let now=-1;const show=i=>{now=i;svg.querySelectorAll('circle').forEach((c,k)=>c.classList.toggle('on',k===i));say(points[i].properties.e);};
 addEventListener('keydown',e=>{if(!points.length)return;if(e.key==='ArrowRight')show((now+1)%points.length);else if(e.key==='ArrowLeft')show((now+points.length-1+(now<0))%points.length);});
 svg.addEventListener('click',e=>{const d=e.target.dataset;if(d.p!==undefined)return show(+d.p);if(d.i===undefined)return;
  const q=new DOMPoint(e.clientX,e.clientY).matrixTransform(svg.getScreenCTM().inverse()),x=q.x+x0,y=y1-q.y;
  const near=ringsOf(areas[+d.i]).flat().reduce((a,b)=>Math.hypot(a[0]-x,a[1]-y)<=Math.hypot(b[0]-x,b[1]-y)?a:b);
  say(`${areas[+d.i].properties.id}: nearest vertex ${near.join(' ')}`);});
});</script></body></html>
"""


def write_issue_map(features: DataFrame, folder: str, theme: str, attachment: str | None = None) -> Path:
    """The feature collection as <attachment> (by default <theme>.geojson) and <theme>_Map.html beside it."""
    out, data = Path(folder), attachment or f"{theme}.geojson"
    out.mkdir(parents=True, exist_ok=True)
    write_feature_collection(features, str(out / data))
    page = out / f"{theme}_Map.html"
    page.write_text(_MAP.replace("__TITLE__", theme.replace("<", "&lt;")).replace("__DATA__", json.dumps(data).replace("<", "\\u003c")), encoding="utf-8")
    return page
