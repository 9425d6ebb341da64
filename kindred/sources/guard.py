"""Which local paths may be read: those at or below some roots, of a size, and links by a policy. Driver-side checks."""

from __future__ import annotations

import os
import stat


class Refused(ValueError):
    """A path that the guard doesn't let through."""


def _inside(path: str, root: str) -> bool:
    return os.path.commonpath([path, root]) == root


class Guard:
    """Paths are made absolute and freed of .. first, so that none leads out of the roots by its spelling.

    There must be a root, and each must exist. A path that is a root itself is let through.
    """

    def __init__(self, roots: list[str], max_size: int, follow_symlinks: bool = False):
        if not roots:
            raise Refused("a guard needs a root")
        self.roots = [os.path.abspath(r) for r in roots]
        if missing := [r for r in self.roots if not os.path.exists(r)]:
            raise Refused(f"no such root: {', '.join(missing)}")
        self.max_size, self.follow_symlinks = max_size, follow_symlinks

    def path(self, path: str) -> None:
        if not any(_inside(os.path.abspath(path), r) for r in self.roots):
            raise Refused(f"outside all roots: {path}")

    def resolved(self, path: str) -> None:
        """As path(), and no link on the way may lead out of the roots; the path needn't exist."""
        self.path(path)
        if not any(_inside(os.path.realpath(path), os.path.realpath(r)) for r in self.roots):
            raise Refused(f"leads outside all roots: {path}")

    def symlink(self, path: str) -> None:
        """A link passes only if links are followed and its end is within the roots; what is no link passes."""
        try:
            if not stat.S_ISLNK(os.lstat(path).st_mode):
                return
            end = os.path.realpath(path, strict=self.follow_symlinks)
        except OSError as e:
            raise Refused(f"can't be read: {path}") from e
        if not self.follow_symlinks:
            raise Refused(f"a symlink, and links aren't followed: {path}")
        self.path(end)

    def size(self, size: int) -> None:
        if size > self.max_size:
            raise Refused(f"{size} bytes, and the limit is {self.max_size}")
