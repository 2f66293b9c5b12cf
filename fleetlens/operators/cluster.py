"""Cluster inventories: relabelling, selectors, policies, permissions, containers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.segments import ROWS_PER_TASK, cut_join
from fleetlens.session import written


def _joined(labels: Column, source: list[str], separator: str) -> Column:
    return F.concat_ws(separator, *[F.coalesce(F.try_element_at(labels, F.lit(s)), F.lit("")) for s in source])


def _set_label(labels: Column, name: str, value: Column) -> Column:
    """Last writer wins; an empty value removes the label."""
    others = F.map_filter(labels, lambda k, _: k != name)
    return F.when(value == "", others).otherwise(F.map_concat(others, F.create_map(F.lit(name), value)))


def relabel(df: DataFrame, rules: list[dict], labels: str = "labels") -> DataFrame:
    """Apply relabelling rules in order. Regexes match the whole value.

    A rule is {action, source, separator, regex, replacement, target}, with the public defaults
    replace, ";", "(.*)" and "$1". Label maps keep the source label.
    """
    for rule in rules:
        action = rule.get("action", "replace")
        whole = f"^(?:{rule.get('regex', '(.*)')})$"
        m = F.col(labels)
        if action == "labelmap":
            hits = F.map_filter(m, lambda k, _: k.rlike(whole))
            # two labels may get one name: the later of them, by their old names, wins
            renamed = F.transform(
                F.array_sort(F.map_entries(hits)),
                lambda e: F.struct(F.regexp_replace(e["key"], whole, rule.get("replacement", "$1")).alias("k"), e["value"].alias("v")),
            )
            made = F.aggregate(
                renamed, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
                lambda done, e: F.map_concat(F.map_filter(done, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])),
            )
            df = df.withColumn("_made", made)
            kept = F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys("_made"), k))
            df = df.withColumn(labels, F.map_concat(kept, F.col("_made"))).drop("_made")
            continue
        value = _joined(m, rule.get("source", []), rule.get("separator", ";"))
        hit = value.rlike(whole)
        if action == "keep":
            df = df.filter(hit)
        elif action == "drop":
            df = df.filter(~hit)
        elif action == "replace":
            new = F.regexp_replace(value, whole, rule.get("replacement", "$1"))
            df = df.withColumn(labels, F.when(hit, _set_label(m, rule["target"], new)).otherwise(m))
        else:
            raise ValueError(f"unknown relabel action {action}")
    return df


def condition_status(
    objects: DataFrame, kind: str, created: str, as_of: Column, give_up_after: int = 120
) -> DataFrame:
    """Status of the condition of one type; given up when still not True after the limit in seconds."""
    hits = F.filter("status.conditions", lambda c: c["type"] == kind)
    out = objects.withColumn("condition", F.try_element_at(hits, F.lit(1))["status"])
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.col(created).cast("timestamp"))
    waiting = ~F.col("condition").eqNullSafe("True")
    return out.withColumn("gave_up", waiting & (age > give_up_after))


def find_by_image(objects: DataFrame, images: list[str], column: str = "images") -> DataFrame:
    """Objects with a container whose image contains any of the texts."""
    any_of = lambda i: reduce(lambda a, b: a | b, [F.contains(i, F.lit(x)) for x in images])
    return objects.filter(F.exists(column, any_of))


def project_paths(objects: DataFrame, spec: dict[str, tuple[str, str]], separator: str = ",") -> DataFrame:
    """Flat text column per (array path, field), elements joined in order."""
    joined = lambda path, field: F.array_join(F.transform(path, lambda r: r[field]), separator)
    return objects.withColumns({name: joined(*where) for name, where in spec.items()})


def explode_containers(objects: DataFrame, path: str = "spec.template.spec.containers") -> DataFrame:
    """One row per container; objects without a container list give none."""
    return objects.withColumn("container", F.explode(path))


def explode_map(df: DataFrame, column: str) -> DataFrame:
    """Map of lists to one row per (key, item)."""
    pairs = df.select("*", F.explode(column).alias("key", "items"))
    return pairs.select("*", F.explode("items").alias("item")).drop("items", column)


def image_inventory(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """(namespace, kind, name, container, image) of all workloads, ordered by all columns."""
    parts = [
        explode_containers(df).select(
            F.col("metadata.namespace").alias("namespace"),
            F.lit(kind).alias("kind"),
            F.col("metadata.name").alias("name"),
            F.col("container.name").alias("container"),
            F.col("container.image").alias("image"),
        )
        for kind, df in kinds
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.orderBy("namespace", "kind", "name", "container", "image")


def match_selector(selectors: DataFrame, objects: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(selector_id, object_id) where the selector's pairs are all among the object's labels.

    ``selectors`` has selector_id, match map, namespaces array (null = all); ``objects`` has
    object_id (unique), namespace, labels map. Postings, a row for each object and each label pair that
    some selector asks for, are all that moves: every selector is looked up by its rarest pair, in its
    namespaces or in all, and an empty selector by the namespace alone. A posting list of more than
    ``rows_per_task`` objects is cut into pieces, each with its own copy of the selectors that ask for
    it. Labels are fetched for candidates of selectors with further pairs only.
    """
    pairs = selectors.select("selector_id", F.explode("match").alias("k", "v"))
    known = pairs.select("k", "v").distinct()
    tags = objects.select("object_id", "namespace", F.explode("labels").alias("k", "v"))
    tags = tags.join(known, ["k", "v"], "left_semi")
    # a pair no object has makes its selector match nothing: it counts as the rarest
    frequency = known.join(tags.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")), ["k", "v"], "left")
    anchor = pairs.join(frequency.fillna(0, ["n"]), ["k", "v"]).groupBy("selector_id").agg(
        F.min_by(F.struct("k", "v"), F.struct("n", "k", "v")).alias("anchor")
    )
    scoped = lambda c: F.concat(F.lit("="), c)  # noqa: E731 - so that no namespace reads like "all"
    scopes = F.coalesce(F.transform(F.array_distinct("namespaces"), scoped), F.array(F.lit("*")))
    list_ = ["scope", "bare", "k", "v"]
    wanted = selectors.join(anchor, "selector_id", "left").select(
        "selector_id", F.explode(scopes).alias("scope"), F.col("anchor").isNull().alias("bare"),
        *[F.coalesce(f"anchor.{c}", F.lit("")).alias(c) for c in "kv"],
        F.when(F.size("match") > 1, F.col("match")).alias("match"),
    )
    wanted = written(wanted, "selectors")
    everything = objects.select("object_id", "namespace", F.lit("").alias("k"), F.lit("").alias("v"), F.lit(True).alias("bare"))
    postings = tags.withColumn("bare", F.lit(False)).unionByName(everything).select(
        "object_id", F.explode(F.array(scoped(F.col("namespace")), F.lit("*"))).alias("scope"), "bare", "k", "v"
    )
    postings = postings.join(wanted.select(*list_).distinct(), list_, "left_semi")
    found = cut_join(postings, wanted, list_, F.col("object_id"), rows_per_task).select("selector_id", "object_id", "match")
    more = found.filter("match IS NOT NULL").join(objects.select("object_id", "labels"), "object_id")
    contained = F.forall(
        F.map_entries("match"), lambda e: F.try_element_at(F.col("labels"), e["key"]).eqNullSafe(e["value"])
    )
    whole = found.filter("match IS NULL").unionByName(more.filter(contained).select("selector_id", "object_id", "match"))
    return whole.select("selector_id", "object_id")


def _term(labels: Column, term: dict) -> Column:
    """One label expression: match_labels plus In, NotIn, Exists, DoesNotExist."""
    tests = [F.try_element_at(labels, F.lit(k)).eqNullSafe(v) for k, v in term.get("labels", {}).items()]
    for e in term.get("expressions", []):
        value = F.try_element_at(labels, F.lit(e["key"]))
        has = value.isNotNull()
        tests.append(
            {
                "In": lambda: has & value.isin(*e["values"]),
                "NotIn": lambda: ~has | ~value.isin(*e["values"]),
                "Exists": lambda: has,
                "DoesNotExist": lambda: ~has,
            }[e["operator"]]()
        )
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def policy_verdict(flows: DataFrame, policies: list[dict]) -> DataFrame:
    """Allowed or not per flow. Policies are specifications, so they become one predicate.

    ``flows`` has pod_labels, peer_ns, peer_pod, peer_ns_name, ns, direction, port, protocol. A policy is
    {namespace, pods, direction, allow: [{peers: [...], ports: [...]}]}; a peer is {ns: term, pods: term}.
    Policies only add permissions: a flow that any policy selects must be allowed by one rule of one of
    them, an unselected flow is allowed. A peer without ``ns`` must be in the policy's own namespace.
    """
    selected, allowed = F.lit(False), F.lit(False)
    for p in policies:
        applies = (
            (F.col("ns") == p["namespace"]) & (F.col("direction") == p["direction"]) & _term(F.col("pod_labels"), p.get("pods", {}))
        )
        rules = F.lit(False)
        for rule in p.get("allow", []):
            peers = F.lit(not rule.get("peers"))
            for peer in rule.get("peers", []):
                where = _term(F.col("peer_ns"), peer["ns"]) if "ns" in peer else F.col("peer_ns_name") == p["namespace"]
                peers = peers | (where & _term(F.col("peer_pod"), peer.get("pods", {})))
            ports = F.lit(not rule.get("ports"))
            for protocol, port in rule.get("ports", []):
                ports = ports | ((F.col("protocol") == protocol) & (F.col("port") == port))
            rules = rules | (peers & ports)
        selected = selected | applies
        allowed = allowed | (applies & rules)
    return flows.withColumn("allowed", ~selected | allowed)


def effective_permissions(bindings: DataFrame, roles: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(subject, namespace, api_group, resource, verb) granted by (subject, namespace, role) bindings.

    ``roles`` has role (unique) and rules array<struct<api_groups, resources, verbs>>; it is unnested
    before the join, in which a role of very many bindings is cut.
    """
    rules = roles.select("role", F.explode("rules").alias("r"))
    grants = (
        rules.select("role", F.explode("r.api_groups").alias("api_group"), "r")
        .select("role", "api_group", F.explode("r.resources").alias("resource"), "r")
        .select("role", "api_group", "resource", F.explode("r.verbs").alias("verb"))
        .distinct()
    )
    bound = bindings.select("subject", "namespace", "role").distinct()
    return cut_join(bound, grants, ["role"], F.col("subject"), rows_per_task, bindings).drop("role").distinct()


def can_i(questions: DataFrame, bindings: DataFrame, roles: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Answer (subject, namespace, api_group, resource, verb) questions; * grants everything.

    A question meets each role of its subject once, with the role's rules as one list, and a role that very many
    questions meet is cut."""
    keys = ["subject", "namespace", "api_group", "resource", "verb"]
    covers = lambda have, want: F.arrays_overlap(have, F.array(F.col(want), F.lit("*")))
    rule = lambda r: covers(r["api_groups"], "api_group") & covers(r["resources"], "resource") & covers(r["verbs"], "verb")
    asked = questions.select(*keys).distinct()
    met = asked.join(bindings.select("subject", "namespace", "role").distinct(), ["subject", "namespace"])
    granted = (
        cut_join(met, roles.select("role", "rules"), ["role"], F.struct(*keys), rows_per_task)
        .filter(F.exists("rules", rule)).select(*keys, F.lit(True).alias("allowed")).distinct()
    )
    return asked.join(granted, keys, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def node_resources(nodes: DataFrame, resources: str = "resources", prefix: str = "accelerator_type:") -> DataFrame:
    """Whole accelerator count and device ids per node from its resource map."""
    ids = F.filter(F.map_keys(resources), lambda k: k.startswith(prefix))
    return nodes.withColumns(
        {
            "gpus": F.coalesce(F.try_element_at(F.col(resources), F.lit("GPU")), F.lit(0.0)).cast("int"),
            "device_ids": F.array_sort(F.transform(ids, lambda k: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))),
        }
    )


def header(headers: str, name: str, default: str) -> Column:
    """First header with the name in any case."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.coalesce(F.try_element_at(hits, F.lit(1))["value"], F.lit(default))
