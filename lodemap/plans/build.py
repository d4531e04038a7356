"""From files to a graph: facts, then nodes and edges, then suggested links between repositories."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.functions import identity, urls
from lodemap.operators import controllers, extract, incremental, relations, stitch, systems
from lodemap.operators.traverse import shared


def _routes(facts: DataFrame, live: DataFrame) -> DataFrame:
    """(repo, path, method, path_form, handler, id): declared routes, those of an app folder, and inherited ones."""
    app = extract.app_routes(live, live)
    routes = live.where("kind = 'route' and path_form is not null").select("repo", "path", "method", "path_form", "handler").unionByName(app.select("repo", "path", "method", "path_form", F.col("method").alias("handler")))
    given = controllers.inherited_routes(live).unionByName(controllers.resource_routes(facts.where("scope = 'runtime'")))
    routes = routes.unionByName(given.select("repo", "path", "method", "path_form", F.lit(None).cast("string").alias("handler"))).distinct()
    return routes.withColumn("id", identity.route_id(F.col("repo"), F.col("method"), F.col("path_form")))


def _requests(live: DataFrame) -> DataFrame:
    """The facts of requests, with an id of file, line, method and path."""
    return live.where("kind = 'request'").withColumn("id", F.concat("file_id", F.lit("::request:"), F.col("line").cast("string"), F.lit(":"), F.concat_ws(" ", "method", "path_form")))


def build(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, name, repo) and edges (src, dst, type, trust_status, repo) of files (repo, path, content).

    Links between requests and routes are SUGGESTED; all other edges are OBSERVED. Tests declare nothing that runs.
    Facts are written to the shared folder once, and all nodes, edges and joins read them from there.
    """
    facts = shared(extract.facts(files))
    live = shared(extract.resolved(facts.where("scope = 'runtime'")))
    steps, flows = extract.workflow(files)
    called, acts, begun = (shared(df) for df in (relations.calls(live), relations.actions(live), relations.starts(live, steps)))
    channels, used = shared(relations.channels(live)), shared(systems.report(facts))
    routed = files.select("repo", "path", urls.page_route(F.col("path")).alias("name")).where("name is not null")
    pages = routed.unionByName(live.where("kind = 'page'").select("repo", "path", "name")).groupBy("repo", "path").agg(F.min("name").alias("name"))
    pages = pages.withColumn("id", identity.file_id(F.col("repo"), F.col("path")))
    routes = shared(_routes(facts, live))
    requests = _requests(live)
    members = live.where("kind in ('class', 'function')").withColumn("id", identity.member_id(F.col("file_id"), F.col("member")))
    node = lambda df, label, id_, name: df.select(id_.alias("id"), F.lit(label).alias("label"), name.alias("name"), "repo")
    paths = files.select("repo", "path", identity.file_id(F.col("repo"), F.col("path")).alias("id"))
    nodes = (
        node(files.select("repo").distinct(), "Repository", F.col("repo"), F.col("repo"))
        .unionByName(node(paths, "CodeFile", F.col("id"), F.col("path")))
        .unionByName(node(members.where("kind = 'class'"), "Class", F.col("id"), F.col("member")))
        .unionByName(node(members.where("kind = 'function'"), "Function", F.col("id"), F.col("member")))
        .unionByName(node(requests, "APIEndpoint", F.col("id"), F.concat_ws(" ", "method", "path_form")))
        .unionByName(node(routes, "BackendRoute", F.col("id"), F.concat_ws(" ", "method", "path_form")))
        .unionByName(node(pages, "Page", F.col("id"), F.col("name")))
        .unionByName(node(called, "CallSite", F.col("id"), F.concat_ws(".", "target_type", "target_method")))
        .unionByName(node(acts, "UIAction", F.col("id"), F.concat_ws(".", "component", "event")))
        .unionByName(node(begun, "WorkflowStart", F.col("id"), F.col("process_key")))
        .unionByName(node(relations.processes(steps), "WorkflowProcess", F.col("id"), F.col("process")))
        .unionByName(node(steps, "WorkflowStep", F.concat(relations.process_id(), F.lit("::step:"), "step"), F.col("step")))
        .unionByName(node(channels.select("repo", F.explode(F.when(F.col("type") == "PUBLISHES_TO", F.array("dst")).when(F.col("type") == "CONSUMED_BY", F.array("src")).when(F.col("type") == "ROUTES_TO", F.array("src", "dst"))).alias("id")), "MessageChannel", F.col("id"), F.element_at(F.split("id", ":", 4), 4)))
        .unionByName(node(used, "ExternalSystem", F.col("id"), F.col("name")))
        .distinct()
    )
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit("OBSERVED").alias("trust_status"), "repo")
    file = identity.file_id(F.col("repo"), F.col("path"))
    edges = (
        edge(paths, F.col("repo"), F.col("id"), "CONTAINS")
        .unionByName(edge(members, F.col("file_id"), F.col("id"), "DEFINES"))
        .unionByName(edge(requests, F.col("file_id"), F.col("id"), "MAKES_REQUEST"))
        .unionByName(edge(routes, F.col("repo"), F.col("id"), "CONTAINS"))
        .unionByName(edge(routes, F.col("id"), file, "DECLARED_IN"))
        .unionByName(edge(requests.where("function is not null"), identity.member_id(F.col("file_id"), F.col("function")), F.col("id"), "MAKES_REQUEST"))
        .unionByName(edge(called, F.col("function_id"), F.col("id"), "DECLARES_CALL"))
        .unionByName(edge(called.where("target is not null"), F.col("function_id"), F.col("target"), "CALLS"))
        .unionByName(edge(acts, F.col("file_id"), F.col("id"), "CONTAINS"))
        .unionByName(edge(acts.where("page_id is not null"), F.col("page_id"), F.col("id"), "HAS_ACTION"))
        .unionByName(edge(acts.where("function_id is not null"), F.col("function_id"), F.col("id"), "DECLARES_ACTION"))
        .unionByName(edge(begun.where("function_id is not null"), F.col("function_id"), F.col("id"), "DECLARES_START"))
        .unionByName(edge(begun.where("target is not null"), F.col("id"), F.col("target"), "RESOLVES_TO"))
        .unionByName(edge(begun.where("target is not null and function_id is not null"), F.col("function_id"), F.col("target"), "STARTS_PROCESS"))
        .unionByName(edge(relations.processes(steps), file, F.col("id"), "CONTAINS"))
        .unionByName(edge(used, F.col("file_id"), F.col("id"), "USES_SYSTEM"))
    )
    edges = edges.unionByName(relations.imports(live).select("src", "dst", F.lit("IMPORTS").alias("type"), F.lit("OBSERVED").alias("trust_status"), "repo"))
    for more in (channels, relations.workflow(live, steps, flows)):
        edges = edges.unionByName(more.select("src", "dst", "type", F.lit("OBSERVED").alias("trust_status"), "repo"))
    # A handler is a function of the route's own file; a name that no function there has links nothing.
    functions = members.where("kind = 'function'").select("repo", "path", F.col("member").alias("handler"), F.col("id").alias("function_id")).distinct()
    edges = edges.unionByName(edge(routes.join(functions, ["repo", "path", "handler"]), F.col("id"), F.col("function_id"), "HANDLED_BY"))
    found = stitch.exact(
        requests.select(F.col("id").alias("request_id"), "method", F.col("path_form").alias("path")), routes.select(F.col("id").alias("route_id"), "method", F.col("path_form").alias("path")).distinct())
    links = found.join(requests.select(F.col("id").alias("request_id"), "repo"), "request_id").select(F.col("request_id").alias("src"), F.col("route_id").alias("dst"), F.lit("TARGETS_ROUTE").alias("type"), "trust_status", "repo")
    return nodes, edges.unionByName(links).distinct()


def import_links(files: DataFrame, folder: str, parts: int = 64) -> incremental.Links:
    """The links from files to the classes that they import, as tables in a shared folder that `sync` keeps up."""
    links, facts = incremental.Links(files.sparkSession, folder, parts), shared(extract.facts(files))
    links.build(relations.class_declarations(facts), relations.import_references(facts))
    return links


def sync(links: incremental.Links, changes: DataFrame, files: DataFrame, repo: str, excluded: list[str] | None = None) -> DataFrame:
    """(action, files): how many files of a diff (status, path, old_path) of a repository were read, dropped and skipped.

    files (repo, path, content) may hold more than what changed; only files to be read are looked at. Where a diff has no
    source at all, no table is read. Links of other files to old and new classes are found anew, all else stays.
    """
    acts = shared(incremental.classified(changes, excluded))
    read = files.where(F.col("repo") == repo).join(acts.where("action = 'read'").select("path"), "path", "left_semi").select("repo", "path", "content")
    gone = acts.where("action <> 'skip'").select(identity.file_id(F.lit(repo), F.col("path")).alias("file"))
    if not gone.isEmpty():
        facts = shared(extract.facts(read))
        links.apply(gone, relations.class_declarations(facts), relations.import_references(facts))
    return incremental.outcome(acts)


def _ends(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes as declarations (file, repo, key, id) and requests as references (file, repo, key, src), by method and path."""
    live = shared(extract.resolved(facts.where("scope = 'runtime'")))
    key = F.concat("method", F.lit(" "), "path_form").alias("key")
    routes = _routes(facts, live).select(identity.file_id(F.col("repo"), F.col("path")).alias("file"), "repo", key, "id")
    requests = _requests(live).select(F.col("file_id").alias("file"), "repo", key, F.col("id").alias("src"))
    return tuple(shared(df.where("key is not null").distinct()) for df in (routes, requests))


def route_links(files: DataFrame, folder: str, parts: int = 64) -> incremental.Links:
    """The suggested links from requests to the routes of their method and path, as tables that `sync_routes` keeps up.

    Beside them stand the facts of all files, cut by repository.
    """
    links = incremental.Links(files.sparkSession, folder, parts, every=True)
    extract.facts(files).write.mode("overwrite").partitionBy("repo").parquet(os.path.join(folder, "facts"))
    links.build(*_ends(_stored(links)))
    return links


def _stored(links: incremental.Links) -> DataFrame:
    """The facts that are kept, without the rows that only keep an empty repository's place."""
    return links.spark.read.parquet(os.path.join(links.folder, "facts")).withColumn("repo", F.col("repo").cast("string")).where("kind is not null")


def sync_routes(links: incremental.Links, changes: DataFrame, files: DataFrame, repo: str, excluded: list[str] | None = None) -> DataFrame:
    """(action, files), as `sync`, for the links of `route_links`: only files that the diff has changed are parsed.

    A base path, client or group in a changed file gives routes and requests of other files another path. So the kept facts
    of the repository (no others) are resolved before and after the change, and every file whose routes or requests differ has
    its links found anew, with those of all repositories that share an old or new key.
    """
    acts = shared(incremental.classified(changes, excluded))
    read = files.where(F.col("repo") == repo).join(acts.where("action = 'read'").select("path"), "path", "left_semi").select("repo", "path", "content")
    gone = acts.where("action <> 'skip'").select("path")
    if not gone.isEmpty():
        before = _stored(links).where(F.col("repo") == repo)
        new = extract.facts(read)
        after = shared(before.join(gone, "path", "left_anti").select(new.columns).unionByName(new))
        old, now = _ends(before.select(new.columns)), _ends(after)
        differs = [a.subtract(b).select("file") for x, y in zip(old, now) for a, b in ((x, y), (y, x))]
        files_ = shared(reduce(DataFrame.unionByName, differs).distinct())
        links.apply(files_, *(df.join(files_, "file", "left_semi") for df in now))
        place = links.spark.createDataFrame([(repo,)], "repo string")
        after.unionByName(place, allowMissingColumns=True).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(os.path.join(links.folder, "facts"))
    return incremental.outcome(acts)


def totals(files: DataFrame) -> DataFrame:
    """(repo, files, lines, symbols, skipped): what a scan found; a file whose content is null or no program could not be read and is skipped."""
    facts = shared(extract.facts(files).where("kind in ('class', 'function', 'error')"))
    found = facts.groupBy("repo").agg(F.count_if(F.col("kind") != "error").alias("symbols"), F.count_if(F.col("kind") == "error").alias("wrong"))
    read = files.groupBy("repo").agg(
        F.count("content").alias("files"), F.coalesce(F.sum(F.size(F.split("content", "\n"))), F.lit(0)).alias("lines"), F.count_if(F.col("content").isNull()).alias("null"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return read.join(found, "repo", "left").select("repo", (F.col("files") - zero(F.col("wrong"))).alias("files"), "lines", zero(F.col("symbols")).alias("symbols"), (F.col("null") + zero(F.col("wrong"))).alias("skipped"))
