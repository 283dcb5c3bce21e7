"""A row-at-a-time reading of path queries over a dict of dicts: the oracle of the compiler's tests."""

from sylvan.model import TREES


def forest(rows):
    out = {}
    for r in rows:
        out.setdefault(tuple(map(bytes, r[0])), {})[bytes(r[1])] = r[2]
    return out


def run(trees, pq, shrink_on_empty=True):
    """[(path, key)] of a path query; trees: path -> key -> element type."""

    def level(path, q, limit, offset):
        out, skipped = [], 0
        for item in q.items if q.left_to_right else q.items[::-1]:
            if item.is_key:
                keys = [item.start] if item.start in trees.get(path, {}) else []
            else:
                keys = sorted((k for k in trees.get(path, {}) if item.contains(k)), reverse=not q.left_to_right)
            for k in keys:
                if item.is_range and limit is not None and limit <= 0:
                    break
                b = q.branch_for(k)
                is_tree = trees[path][k] in TREES
                if is_tree and b.query is not None:
                    rows, s = level((*path, k, *(b.path or ())), b.query, limit, offset - skipped)
                    out += rows
                    skipped += s
                    if limit is not None:
                        limit = max(0, limit - (len(rows) or int(shrink_on_empty)))
                elif is_tree and b.path:
                    at = (*path, k, *b.path[:-1])
                    if offset - skipped > 0:
                        skipped += 1
                    else:
                        if b.path[-1] in trees.get(at, {}):
                            out.append((at, b.path[-1]))
                        if limit is not None:
                            limit = max(0, limit - 1)
                elif offset - skipped > 0:
                    skipped += 1
                else:
                    out.append((path, k))
                    if limit is not None:
                        limit = max(0, limit - 1)
            if limit == 0:
                break
        return out, skipped

    return level(tuple(pq.path), pq.query, pq.limit, pq.offset or 0)[0]
