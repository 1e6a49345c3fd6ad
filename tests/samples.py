"""Small log samples, written for these tests."""

MYSQL_SLOW = """# Time: 2025-11-03T08:15:30.250000Z
# Query_time: 4.500 Lock_time: 0.020 Rows_sent: 12 Rows_examined: 5000
SET timestamp=1762157730;
UPDATE stock SET held = 3 WHERE sku = 'A-77';
# Time: 2025-11-03T08:15:41.750000Z
# Query_time: 0.250 Lock_time: 0.000 Rows_sent: 7 Rows_examined: 7
SET timestamp=1762157741;
SELECT name FROM depots;
# Time: 2025-11-03T08:16:02.000000Z
# Query_time: 1.500 Lock_time: 0.005 Rows_sent: 0 Rows_examined: 640
SET timestamp=1762157762;
UPDATE stock SET held = 9 WHERE sku = 'B-2';
"""

PG_STATEMENTS = """2025-11-03 09:30:00.500 UTC [812] app@wares LOG:  duration: 62.500 ms  statement: DELETE FROM carts WHERE age_days > 30;
2025-11-03 09:30:04.000 UTC [812] app@wares LOG:  duration: 2.250 s
2025-11-03 09:30:04.000 UTC [812] app@wares STATEMENT:  SELECT sum(total) FROM invoices WHERE year = 2024;
2025-11-03 09:30:09.125 UTC [812] app@wares LOG:  duration: 187.500 ms  statement: DELETE FROM carts WHERE age_days > 7;
"""

MYSQL_ERRORS = """2025-11-03T10:00:00.000001Z 8 [Note] client asked for a backup
2025-11-03T10:00:05.000000Z 8 [ERROR] slave I/O thread lost its source
2025-11-03T10:00:06.000000Z 0 [Warning] purge thread is behind
2025-11-03T10:00:07.000000Z 9 [Note] DEADLOCK between two updates of stock
2025-11-03T10:00:08.000000Z 8 [Note] relay log opened anew
2025-11-03T10:00:09.000000Z 0 [Note] recovery completed in 4 s
"""

PG_ERRORS = """2025-11-03 11:00:01 UTC [20] LOG: vacuum of "wares.carts" took 9 s
2025-11-03 11:00:02 UTC [21] LOG: redo starts at 2/9A000028
2025-11-03 11:00:03 UTC [22] ERROR: replica asks for a removed segment
2025-11-03 11:00:04 UTC [23] LOG: checkpoint begins
2025-11-03 11:00:05 UTC [24] LOG: wal sender for standby_b ends
2025-11-03 11:00:06 UTC [25] ERROR: Deadlock among three writers
"""
