# Own scenarios in the golden format
statement ok
CREATE DATABASE shop

statement error
CREATE DATABASE shop

statement ok
USE shop

statement ok
CREATE TABLE goods (id INT, price DOUBLE, name STRING) UNIQUE KEY (id)

statement ok
INSERT INTO goods VALUES (10, 2.5, 'pear'),
  (11, 4, 'plum'), (12, 1.25, 'fig')

query
SELECT id, price * 2, name FROM goods WHERE price >= 2 OR name = 'fig' AND id < 12
----
10 5.000000 pear
11 8.000000 plum

query
SELECT COUNT(id), SUM(price) FROM goods
----
3 7.750000

statement ok
INSERT INTO goods VALUES (11, 3.5, NULL)

query
SELECT * FROM goods
----
10 2.500000 pear
11 3.500000 Null
12 1.250000 fig

statement ok
FLUSH goods

query
DELETE FROM goods WHERE price < 2
----
1

query
SELECT id FROM goods
----
10
11

statement error
SELECT price % 0.0 FROM goods

query
SELECT * FROM (SELECT COUNT(range) FROM range(1, 8, 2))
----
4

statement ok
DROP DATABASE shop
