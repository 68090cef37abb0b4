"""Plugins: modules with any of the hooks below, registered by hand or as entry points."""

from __future__ import annotations

import warnings
from importlib.metadata import entry_points

#: preconfigure(values) and configure(config) -> config; the others get the registry they add to.
HOOKS = ("preconfigure", "configure", "register_http_endpoint", "register_http_middleware", "register_command", "register_shell_command")


class Plugins:
    def __init__(self):
        self.modules: dict[str, object] = {}
        self.blocked: set[str] = set()

    def load(self, group: str = "wayfind.ext") -> None:
        for point in entry_points(group=group):
            self.register(point.load(), point.name)

    def register(self, module, name: str | None = None) -> None:
        name = name or module.__name__
        if name in self.blocked:
            warnings.warn(f"plugin {name} is blocked", stacklevel=2)
        else:
            self.modules[name] = module

    def block(self, module, reason: str = "") -> None:
        name = module if isinstance(module, str) else module.__name__
        self.modules.pop(name, None)
        self.blocked.add(name)

    def call(self, hook: str, *args) -> list:
        """The results of all plugins that have the hook. What goes wrong inside a plugin is raised."""
        if hook not in HOOKS:
            raise ValueError(f"unknown hook {hook}")
        return [getattr(m, hook)(*args) for m in list(self.modules.values()) if hasattr(m, hook)]
