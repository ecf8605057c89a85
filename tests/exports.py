"""Small exports written for the tests, one for each dialect."""

from __future__ import annotations


def _rows(n, make):
    return [make(i) for i in range(n)]


def aethalometer():
    head = "a,b,c,d,e,f,Serial number,Optical config,Date / time local,IR BCc,Biomass BCc  (ng/m^3),Fossil fuel BCc  (ng/m^3),AAE,Note"
    return "\n".join([head, *_rows(5, lambda i: f"1,2,3,4,5,6,MA-1,DUAL,2024-03-01T10:00:0{i},{100 + i},{10 + i},{90 + i},1.{i},x{i}")])


def cpc_focused():
    pre = ["Title,x,y,z", "a,b,c,d", "a,b,c,d", "a,b,c,d", "Start Date,03/01/24,,", 'Serial,"CPC 39123 !!",,', "Start Time,10:00:00,,", "x,,,", "x,,,", "x,,,", "x,,,", "x,,,", "x,,,", "x,,,"]
    return "\n".join([*pre, "Time,Conc,c,d", *_rows(6, lambda i: f"t{i},{1000 + i if i != 2 else 'bad'},0,0"), "end,1,1,1", "end,1,1,1", "end,1,1,1"])


def cpc_full():
    names = ["Instrument ID", "Start Date", "Start Time", "[1] Conc", *(f"k{i}" for i in range(10))]
    row = lambda i: ",".join(["CPC: 3007 xyz", "03/01/24", f"10:00:0{i}", str(500 + i), *(str(i) for _ in range(10))])
    return "\n".join(["x", "x", ",".join(names), *_rows(5, row)])


def discmini():
    pre = ["export", "x", "a b c d e 4711 f", "x"]
    return "\n".join([*pre, "Time\tTimeStamp\tNumber\tSize\tLDSA\tFilter\tDiff", *_rows(5, lambda i: f"{i}\t01-Mar-2024 10:00:0{i}\t{2000 + i}\t{40 + i}\t{8 + i}\t0\t1")])


def elpi(density=1.0):
    mids = [0.01 * 1.6**k for k in range(14)]
    edges = [0.008 * 1.6**k for k in range(15)]
    pre = [f"ELPI,\"E77\"", *("x" for _ in range(30)), f"D50values(um)={chr(9).join(f'{e:.6f}' for e in edges)}", f"CalculatedDi(um)={chr(9).join(f'{m:.6f}' for m in mids)}", f"Density(g/cm^3)={density}", "CalculatedMoment=Number", "CalculatedType=dN/dlogDp"]
    header = "\t".join(["Date Time (yyyy/mm/dd hh:mm)", *(f"e{k}" for k in range(33)), *(f"b{k}" for k in range(14)), "tail"])
    row = lambda i: "\t".join([f"2024/03/01 10:00:0{i}.500", *("0" for _ in range(33)), *(str(k + i) for k in range(14)), "t"])
    return "\n".join([*pre, header, "\t".join("unit" for _ in range(49)), *_rows(5, row)])


def fmps(english=False):
    mids = [6.04, 6.98, 8.06, 9.31]
    date = 'Date,"Mar 1, 2024",x' if False else ""
    first = "Start Time,Friday Mar 1,2024 10:00:00 AM" if english else 'Start,"1. marts 2024 kl. 10:00:00"'
    pre = [date or first, "x", "x", "x", "a,b,FMPS 12345678", *("x" for _ in range(7)), "Concentration (#/cm3),,"]
    pad = ["z"] * 11
    lines = [*pre, ",".join(["Diameter", *map(str, mids), *pad])]
    clock = (lambda i: f"10:00:{2 * i:02d} AM") if english else (lambda i: str(2 * i))
    lines.append(",".join(["Time" if english else "Elapsed Time [s]", *("n" for _ in mids), *pad]))
    return "\n".join([*lines, *_rows(5, lambda i: ",".join([clock(i), *(str(10 * k + i) for k in range(4)), *("0" for _ in pad)]))])


def fourtec():
    pre = ["x,y,z,q,w", "x,y,z,q,w", "a,b,F99,q,w", *("x,y,z,q,w" for _ in range(5))]
    return "\n".join([*pre, "Date,Time,Temp,Dew,RH", *_rows(5, lambda i: f"01-03-2024,10:00:0{i},2{i}.5,9,4{i}.0")])


def grimm_soft():
    pre = ["<Header>", "Device: x", "Location: Hall /l", "Mass of g/m", *("x" for _ in range(3)), "Data: particles/l", *("x" for _ in range(5))]
    pre[7] = "Serial: G12".replace(": ", ":") + " particles/l"
    return "\n".join([*pre, "Date;0.25 µm;0.5 µm;1.0 µm", *_rows(5, lambda i: f"row 01/03/2024 10:00:0{i}.000;{1000 + i};200;30")])


def grimm_inst():
    return "\n".join(["File name;x;y Count", "Date;0.25-0.5;0.5-1.0;>32", "3/1/2024;1000;200;30", *_rows(4, lambda i: f"3/1/2024 12:00:0{i + 1} AM;{1000 + i};200;30")])


def nanoscan():
    mids = [11.5, 15.4, 20.5, 27.4, 36.5, 48.7, 64.9, 86.6, 115.5, 154.0, 205.4, 273.8, 365.2]
    names = ["File Index", "Sample #", "Date Time", *map(str, mids), "Total Conc", "Particle Density (g/cc)"]
    row = lambda i: ",".join(["0", str(i), f"2024/03/01 10:0{i}:00", *(str(k + i) for k in range(13)), "999", "1.2"])
    return "\n".join(["Model,3910", "x", "Serial Number,N55", "", "x", "dN/dlogDp data", ",".join(names), *_rows(5, row)])


def opcn3():
    edges = [0.35 * 1.2**k for k in range(24)]
    names = ["datetime", *(f"Bin{e:.4f}" for e in edges), "Period", "FlowRate", "Serial"]
    return "\n".join([",".join(names), *_rows(5, lambda i: ",".join([f"2024-03-01T10:00:0{i}.123456", *(str(k) for k in range(24)), "200", "500" if i else "0", "O1"]))])


def ops_direct(start="10:00:00", serial="3330"):
    cuts = [0.3 * 1.25**k for k in range(17)]
    pre = ["Instrument Name,Sizer", f"Serial Number,{serial}", f"Test Start Time,{start}", "Test Start Date,2024/03/01", "Sample Interval [H:M:S],0:1:0", *(f"Bin {k + 1} Cut Point (um),{c:.3f}" for k, c in enumerate(cuts)), "Density,1.5"]
    pre += [f"note {k},x" for k in range(36 - len(pre))] + [","]
    names = ["Elapsed Time [s]", *(f"Bin {k}" for k in range(1, 18)), "Deadtime (s)", "Temperature (C)"]
    row = lambda i: ",".join([str(60 * i), *(str(100 - 5 * k + i) for k in range(17)), "60" if i == 3 else "2", "21"])
    return "\n".join([*pre, ",".join(names), *_rows(5, row)])


def ops_aim():
    cuts = [0.3, 0.374, 0.465, 0.579, 0.721, 0.897, 1.117, 1.391, 1.732, 2.156, 2.685, 3.343, 4.162, 5.182, 6.451, 8.031, 10.0]
    mids = [(a + b) / 2 for a, b in zip(cuts[:-1], cuts[1:])]
    pre = ["Sample File,x", "Serial Number,A9", "Density,1.0", "x", "x", "Weight,Number", "Units,dW/dlogDp", "x", "x", "x"]
    pad = [""] * 17
    lower, upper = ",".join([*pad, *map(str, cuts[:-1]), ""]), ",".join([*pad, *map(str, cuts[1:]), ""])
    names = ["Sample #", "Date", "Start Time", *(f"k{k}" for k in range(14)), *(f"{m:.4f}" for m in mids), "tail"]
    row = lambda i: ",".join([str(i), "03/01/2024", f"10:0{i}:00", *("0" for _ in range(14)), *(str(k + i) for k in range(16)), "t"])
    return "\n".join([*pre, lower, upper, "x", ",".join(names), *_rows(5, row)])


def partector(samples=True):
    pre = ["Partector 123", "Start: 01.03.2024 10:00:00", *("x" for _ in range(8))]
    return "\n".join([*pre, "time\tLDSA\tTEM\tFlow\tT", *_rows(8, lambda i: f"{60 * i}\t{5 + i}\t{int(samples and 2 <= i <= 5)}\t0.5\t20")])


def smps():
    mids = [round(10 ** ((k - 0.5) / 64), 1) for k in range(70, 78)]
    pre = ["Sample File,x", "Classifier Model,3082", "Detector Model,3750", "Weight,Number", "Units,dW/dlogDp", "Density,1.0", *("x,y" for _ in range(19))]
    names = ["Sample #", "Date", "Start Time", "a", "b", "c", "d", *map(str, mids), "Scan"]
    row = lambda i: ",".join([str(i), "01/03/2024", f"10:0{i}:00", "0", "0", "0", "0", *(str(10 * k + i) for k in range(8)), "up"])
    return "\n".join([*pre, ",".join(names), *_rows(5, row)])
