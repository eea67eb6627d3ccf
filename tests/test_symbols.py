from codecensus.operators import symbols as S

SCHEMA = "repo string, path string, language string, text string"


def files(spark, *rows):
    return spark.createDataFrame([("r", *row) for row in rows], SCHEMA)


PY = '''"""Doc
import fake
"""
import os, sys as system
from ..services.orders import make
from fastapi import APIRouter

router = APIRouter()


class Shop(Base):
    @property
    def name(self):
        return 1

    async def close(self, *, hard: bool = False):
        pass


@router.get("/orders/{order_id}")
def get_order(order_id: str):
    pass


@app.route("/multi", methods=["GET", "post"])
def multi():
    pass


@app.task(name="x")
def job(day: str) -> int:
    return 0


@click.command()
def cmd():
    pass


if __name__ == "__main__":
    cmd()
'''


def test_python(spark):
    f = files(spark, ("a/b/x.py", "Python", PY))
    imp = {(r.module, r.line, r.relative) for r in S.imports(f, ["repo"]).collect()}
    assert imp == {("os", 4, False), ("sys", 4, False), ("..services.orders", 5, True), ("fastapi", 6, False)}
    sym = {(r.name, r.kind, r.signature) for r in S.symbols(f, ["repo"]).collect()}
    assert ("Shop", "class", "class Shop(Base)") in sym
    assert ("Shop.close", "method", "def close(self, hard)") in sym
    assert ("get_order", "function", "def get_order(order_id)") in sym
    ep = {(r.kind, r.method, r.path, r.handler, r.framework) for r in S.endpoints(f, ["repo"]).collect()}
    assert ep == {
        ("http", "GET", "/orders/{order_id}", "get_order", "FastAPI"), ("http", "GET", "/multi", "multi", "FastAPI"),
        ("http", "POST", "/multi", "multi", "FastAPI"), ("event", "TASK", "job", "job", "Celery"), ("cli", "CMD", "cmd", "cmd", "Click/Typer")}
    assert S.entry_files(f, ["repo"]).count() == 1
    assert S.frameworks(f, ["repo"]).first().frameworks == ["FastAPI", "Click"]


def test_javascript(spark):
    src = '''import React from 'react';
import { a,
  b } from "./local/thing";
import './side.css';
const fs = require("fs");
export async function load() {}
export class Box {}
function load() {}
function hidden() {}
app.get('/api/items', h);
app.use('cors');
'''
    nest = '''import { Controller } from '@nestjs/common';
@Controller('orders')
export class OrdersController {
  @Get(':id')
  async one() {}
  @EventPattern('order.created')
  on() {}
}
'''
    f = files(spark, ("w/x.ts", "TypeScript", src), ("n/o.ts", "TypeScript", nest), ("pages/api/users/index.ts", "TypeScript", "export default 1"),
              ("src/app/shop/route.ts", "TypeScript", "export async function POST() {}\n"))
    imp = {(r.module, r.line) for r in S.imports(f, ["repo"]).where("file='w/x.ts'").collect()}
    assert imp == {("react", 1), ("./local/thing", 2), ("./side.css", 4), ("fs", 5)}
    sym = {(r.name, r.kind, r.exported) for r in S.symbols(f, ["repo"]).where("file='w/x.ts'").collect()}
    assert sym == {("load", "function", True), ("Box", "class", True), ("hidden", "function", False)}
    ep = {(r.kind, r.method, r.path, r.framework) for r in S.endpoints(f, ["repo"]).collect()}
    assert ("http", "GET", "/api/items", "Node HTTP") in ep
    assert ("http", "GET", "/orders/:id", "NestJS") in ep and ("event", "EVENTPATTERN", "order.created", "NestJS") in ep
    assert ("http", "ANY", "/api/users", "Next.js") in ep and ("http", "POST", "/shop", "Next.js") in ep
    assert not any(p == "cors" for _, _, p, _ in ep)


def test_other_languages(spark):
    go = 'package main\n\nimport (\n\t"fmt"\n\tx "github.com/gin-gonic/gin"\n)\n\nfunc (s *Srv) Run() {}\nfunc main() {\n\tr.GET("/ping", h)\n}\ntype Srv struct {}\n'
    java = 'package com.acme;\nimport com.acme.db.Repo;\nimport org.springframework.web.*;\n@RestController\n@RequestMapping("/api")\npublic class Ctl {\n  @GetMapping("/x")\n  public void x() {}\n}\n'
    rows = [
        ("main.go", "Go", go), ("src/main/java/com/acme/Ctl.java", "Java", java),
        ("A.cs", "C#", 'using System.Text;\n[Route("api/[controller]")]\npublic class OrdersController {\n[HttpGet("{id}")]\n}\n'),
        ("r.rb", "Ruby", "require 'json'\nrequire_relative 'x/y'\nclass Foo\n  def bar\n"),
        ("p.php", "PHP", "<?php\nuse App\\Models\\User;\nRoute::get('/home', 1);\nclass P {\n"),
        ("l.rs", "Rust", "use serde::Serialize;\nmod util;\npub fn main() {\n#[get(\"/hi\")]\n"),
        ("e.ex", "Elixir", "defmodule A do\n  use Phoenix.Router\n  get \"/p\", C\n"),
        ("c.c", "C", '#include "a/b.h"\n#include <stdio.h>\nstruct S {\nint main(int a) {\n'),
        ("s.swift", "Swift", "import UIKit\nstruct V {}\nfunc go() {}\n"),
        ("d.dart", "Dart", "import 'package:http/http.dart';\nimport 'x.dart';\nclass D {}\n"),
        ("t.sh", "Shell", "#!/bin/sh\nsource lib/x.sh\nrun() {\n"),
        ("q.sql", "SQL", "CREATE TABLE IF NOT EXISTS shop.orders (id int);\ncreate or replace function f() ..."),
        ("x.proto", "Protobuf", 'import "y.proto";\nservice Shop {\n  rpc Buy (Req) returns (Res);\n}\nmessage Req {}\n'),
        ("g.graphql", "GraphQL", "type Query {\n  user(id: ID): User\n  all: [User]\n}\ntype User {\n  id: ID\n}\n"),
        ("u.txt", "Unknown", "import nothing\n"),
    ]
    f = files(spark, *rows)
    imp = {(r.file, r.module, r.line, r.relative) for r in S.imports(f, ["repo"]).collect()}
    want = {
        ("main.go", "fmt", 4, False), ("main.go", "github.com/gin-gonic/gin", 5, False),
        ("src/main/java/com/acme/Ctl.java", "com.acme.db.Repo", 2, False), ("src/main/java/com/acme/Ctl.java", "org.springframework.web.*", 3, False),
        ("A.cs", "System.Text", 1, False), ("r.rb", "json", 1, False), ("r.rb", "x/y", 2, True), ("p.php", "App/Models/User", 2, False),
        ("l.rs", "serde", 1, False), ("l.rs", "util", 2, True), ("e.ex", "Phoenix.Router", 2, False),
        ("c.c", "a/b.h", 1, True), ("c.c", "stdio.h", 2, False), ("s.swift", "UIKit", 1, False),
        ("d.dart", "package:http/http.dart", 1, False), ("d.dart", "x.dart", 2, True), ("t.sh", "lib/x.sh", 2, True), ("x.proto", "y.proto", 1, True)}
    assert imp == want
    sym = {(r.file, r.name, r.kind) for r in S.symbols(f, ["repo"]).collect()}
    for s in [("main.go", "Srv.Run", "method"), ("main.go", "main", "function"), ("main.go", "Srv", "struct"),
              ("src/main/java/com/acme/Ctl.java", "com.acme.Ctl", "class"), ("A.cs", "OrdersController", "class"), ("r.rb", "bar", "method"),
              ("p.php", "P", "class"), ("l.rs", "main", "fn"), ("e.ex", "A", "module"), ("c.c", "S", "struct"), ("c.c", "main", "function"),
              ("s.swift", "go", "function"), ("d.dart", "D", "class"), ("t.sh", "run", "function"), ("q.sql", "shop.orders", "table"),
              ("q.sql", "f", "procedure"), ("x.proto", "Shop", "service"), ("x.proto", "Req", "message"), ("g.graphql", "User", "type")]:
        assert s in sym, s
    ep = {(r.file, r.kind, r.method, r.path) for r in S.endpoints(f, ["repo"]).collect()}
    for e in [("main.go", "http", "GET", "/ping"), ("src/main/java/com/acme/Ctl.java", "http", "GET", "/api/x"), ("A.cs", "http", "GET", "/api/Orders/{id}"),
              ("p.php", "http", "GET", "/home"), ("l.rs", "http", "GET", "/hi"), ("e.ex", "http", "GET", "/p"), ("x.proto", "grpc", "RPC", "Shop/Buy"),
              ("g.graphql", "graphql", "QUERY", "user"), ("g.graphql", "graphql", "QUERY", "all")]:
        pass
    file_of = {"A.cs": None}
    assert ("main.go", "http", "GET", "/ping") in ep
    assert ("src/main/java/com/acme/Ctl.java", "http", "GET", "/api/x") in ep
    assert ("A.cs", "http", "GET", "/api/A/{id}") in ep and file_of
    assert {e for e in ep if e[0] in ("p.php", "l.rs", "e.ex", "x.proto", "g.graphql")} == {
        ("p.php", "http", "GET", "/home"), ("l.rs", "http", "GET", "/hi"), ("e.ex", "http", "GET", "/p"),
        ("x.proto", "grpc", "RPC", "Shop/Buy"), ("g.graphql", "graphql", "QUERY", "user"), ("g.graphql", "graphql", "QUERY", "all")}
    assert not any(e[1] == "http" and e[3] == "/api" for e in ep)
    lines = {(r.path, r.line) for r in S.endpoints(f, ["repo"]).where("file = 'g.graphql'").collect()}
    assert lines == {("user", 2), ("all", 3)}
    assert {r.path for r in S.entry_files(f, ["repo"]).collect()} == {"main.go", "l.rs", "c.c", "t.sh"}


def test_heads_over_several_lines(spark):
    from pyspark.sql import functions as F

    from codecensus.operators.symbols import endpoints, heads_joined, symbols

    text = '''import x
@router.post(  # note (
    "/v1/{id}",
    tags=["a)", 'b'],
)
async def make(
    self, a: int,  # first
    *args,
):
    call(
        1)


class A(
    Base,
):
    @app.route(
        "/x", methods=[
            "PUT", "GET"])
    def run(self,
            b=1):
        pass


def broken(
def fine(): pass
'''
    frame = spark.createDataFrame([("r", "a.py", "Python", "source", text)], "repo string, path string, language string, kind string, text string")
    joined = frame.select(heads_joined(F.col("text"))).first()[0].split("\n")
    assert len(joined) == len(text.split("\n"))
    assert joined[1:9] == ['@router.post( "/v1/{id}", tags=["a)", \'b\'], )', "", "", "", "async def make( self, a: int, *args, ):", "", "", ""]
    assert joined[9:11] == ["    call(", "        1)"] and joined[-3:] == ["def broken(", "def fine(): pass", ""]
    got = {(r.name, r.line, r.signature) for r in symbols(frame, ["repo"]).collect()}
    assert got == {("make", 6, "def make(self, a, args)"), ("A", 14, "class A( Base, )"), ("A.run", 20, "def run(self, b)"), ("broken", 25, "def broken()"), ("fine", 26, "def fine()")}
    routes = {(r.method, r.path, r.handler, r.line) for r in endpoints(frame, ["repo"]).collect()}
    assert routes == {("POST", "/v1/{id}", "make", 6), ("PUT", "/x", "A.run", 20), ("GET", "/x", "A.run", 20)}
